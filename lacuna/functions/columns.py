"""Columns that the optimiser evaluates once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds the columns through a one-row generator.

    Projections and filters above are then not merged into the expressions, so
    a long text expression used several times is neither copied nor run again.
    """
    kept = rows.drop(*[c for c in columns if c in rows.columns])
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return kept.select("*", F.inline(F.array(made))) if kept.columns == rows.columns else rows.select(*kept.columns, F.inline(F.array(made)))


def count_all() -> Column:
    return F.count(F.lit(1))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the rows that have both values; null where one side is constant (``corr`` would divide by zero)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    return F.when((vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))
