"""All queries of the core, by name."""

from __future__ import annotations

from lacuna.plans import deployment, measures, more, quality, relations

_MODULES = [quality, measures, relations, deployment, more]

FLAGSHIP = relations.h3


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
