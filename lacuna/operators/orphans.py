"""Problem 1: references whose target does not exist, or does not exist at that time.

A reference is a tuple of columns.  Rows are grouped by null mask (which of the
columns are null) and each mask is anti-joined on its non-null columns only.
What a null means is declared by ``match``, as in SQL foreign keys:

* ``simple``  - a reference with any null is not checked;
* ``partial`` - the non-null columns must agree with some target row;
* ``full``    - all null is fine, some null is an orphan of kind ``partial``,
  no null must agree with some target row.

``find_component_orphans`` declares a fourth: each non-null column names a target
of its own in a table of its own, whatever the others hold.

With validity columns a target row counts only while it is in force.  A reference
at time t is in force if a row of its target that starts no later ends after t.
Target rows are folded by week of their start, so a target key, however many rows
it has, is one short list of weeks and latest ends; only references that this
list leaves open are anti-joined with the rows starting in their own week.  Target
rows never multiply references, and neither a hot reference nor a hot target is
gathered in one task: references are the streamed side, whose hot keys adaptive
skew handling splits.

Defined results: empty references give no rows; empty targets make each checked
reference ``missing``; a reference without a time is an orphan only if its
target has no row at all; target rows without a start are never in force.
Columns of the references other than those in ``keep`` are not carried, so
clashing names between the tables do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.session import cut

_FOREVER = "9999-12-31 00:00:00"
_WEEK = 7 * 86_400


def _week(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / _WEEK)


def _validity(targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """From (keys, _start, _end): one row per key (``_first`` start, ``_weeks`` with the latest end of the rows starting in each), and the distinct rows by week."""
    stop = F.coalesce(F.col("_end"), F.lit(_FOREVER).cast("timestamp"))
    rows = targets.groupBy(*keys, "_start").agg(F.max(stop).alias("_stop")).withColumn("_week", _week(F.col("_start")))
    weeks = rows.groupBy(*keys, "_week").agg(F.max("_stop").alias("_stop"), F.min("_start").alias("_start"))
    by_key = weeks.groupBy(*keys).agg(
        F.min("_start").alias("_first"),
        F.collect_list(F.when(F.col("_week").isNotNull(), F.struct("_week", "_stop"))).alias("_weeks"),
    )
    return by_key, rows.where(F.col("_stop") > F.col("_start"))


def _lost_in_time(some: DataFrame, known: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows of ``some`` (keys, _time, keep) that have no row in force: keep and kind."""
    by_key, rows = _validity(known, keys)
    # cut, so that both sides of the joins are plain shuffles and a hot key of the references can be split
    by_key = cut(by_key)
    at = F.col("_time").cast("timestamp")
    earlier = F.filter("_weeks", lambda w: (w["_week"] < F.col("_at_week")) & (w["_stop"] > F.col("_at")))
    timed = some.withColumn("_at", at).withColumn("_at_week", _week(F.col("_at")))
    # one join tells what has no row at all; of the rest it leaves what no earlier week covers
    open_ = timed.join(by_key.withColumn("_known", F.lit(True)), keys, "left").where(F.col("_known").isNull() | (F.col("_at").isNotNull() & (F.size(earlier) == 0)))
    open_ = open_.select(*dict.fromkeys([*keys, *keep]), "_at", "_at_week", "_first", "_known")
    here = rows.select(*[F.col(k).alias(f"_t{k}") for k in keys], "_week", "_start", "_stop")
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_t{k}") for k in keys))
    lost = open_.join(here, same & (F.col("_at_week") == F.col("_week")) & (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_stop")), "left_anti")
    kind = F.when(F.col("_known").isNull(), "missing").when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), "late").otherwise("deleted")
    return lost.select(*keep, kind.alias("kind"))


def _masked(refs: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)))


def find_orphans(
    refs: DataFrame,
    ref_columns: Sequence[str],
    targets: DataFrame,
    target_columns: Sequence[str],
    *,
    match: str = "simple",
    ref_time: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Orphan references: the ``keep`` columns, ``null_mask`` (bit i: column i is null) and ``kind``.

    kind: ``missing`` (no such target), ``late`` (before its first row), ``deleted``
    (no row in force at that time), ``partial`` (partly null under ``full``).
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    if len(ref_columns) != len(target_columns) or not ref_columns:
        raise ValueError("references and targets need the same number of columns")
    n = len(ref_columns)
    extra = [] if ref_time is None else [ref_time]
    slim = refs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(ref_columns)],
        *[F.col(c).alias("_time") for c in extra],
        *[F.col(c) for c in keep],
    )
    slim = slim.withColumn("null_mask", _masked(slim, [f"_k{i}" for i in range(n)]))
    span_columns = [] if ref_time is None else [F.col(valid_from).cast("timestamp").alias("_start"), F.col(valid_to).cast("timestamp").alias("_end")]
    goal = targets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(target_columns)], *span_columns)

    parts: list[DataFrame] = []
    masks = [0] if match == "simple" or match == "full" else range((1 << n) - 1)
    for mask in masks:
        keys = [f"_k{i}" for i in range(n) if not mask >> i & 1]
        some = slim.where(F.col("null_mask") == mask)
        known = goal.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
        if ref_time is None:
            lost = some.join(known.select(*keys).distinct(), keys, "left_anti").withColumn("kind", F.lit("missing"))
        else:
            lost = _lost_in_time(some, known, keys, [*keep, "null_mask"])
        parts.append(lost.select(*keep, "null_mask", "kind"))
    if match == "full":
        some_null = slim.where((F.col("null_mask") > 0) & (F.col("null_mask") < (1 << n) - 1))
        parts.append(some_null.withColumn("kind", F.lit("partial")).select(*keep, "null_mask", "kind"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Component:
    """A column of a reference and the table its values must be found in."""

    name: str
    column: str
    targets: DataFrame
    target_column: str
    valid_from: str | None = None
    valid_to: str | None = None


def find_component_orphans(refs: DataFrame, components: Sequence[Component], ref_time: str, keep: Sequence[str] = ()) -> DataFrame:
    """Orphans of references each of whose columns names a target of its own: keep, ref_field, null_mask, kind.

    A reference becomes a row for each non-null column of its null mask, so all masks and columns are anti-joined at
    once against the targets of all columns, and the references are read once.
    """
    slim = refs.select(*[F.col(c.column).cast("string").alias(f"_k{i}") for i, c in enumerate(components)], F.col(ref_time).alias("_time"), *[F.col(c) for c in keep])
    mask = _masked(slim, [f"_k{i}" for i in range(len(components))])
    named = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_k{i}").alias("_k"), mask.alias("null_mask")) for i in range(len(components))])
    some = slim.select("_time", *keep, F.inline(named)).where(F.col("_k").isNotNull())
    known = reduce(
        DataFrame.unionByName,
        (
            c.targets.select(F.lit(i).alias("_c"), F.col(c.target_column).cast("string").alias("_k"), F.col(c.valid_from).cast("timestamp").alias("_start"), F.col(c.valid_to).cast("timestamp").alias("_end"))
            for i, c in enumerate(components)
        ),
    )
    lost = _lost_in_time(some, known.where(F.col("_k").isNotNull()), ["_c", "_k"], [*keep, "null_mask", "_c"])
    names = F.array(*[F.lit(c.name) for c in components])
    return lost.select(*keep, names[F.col("_c")].alias("ref_field"), "null_mask", "kind")


def orphan_report(orphans: DataFrame, table: str, time: str, period: str = "month") -> DataFrame:
    """Orphans counted by table, null mask, period and kind; rows of one period are counted before anything is shuffled."""
    return orphans.groupBy(
        F.col(table).alias("ref_field"),
        "null_mask",
        F.date_format(F.date_trunc(period, F.col(time)), "yyyy-MM-dd").alias("period"),
        "kind",
    ).agg(F.count(F.lit(1)).alias("orphans"))
