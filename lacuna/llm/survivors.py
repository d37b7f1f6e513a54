"""Problem 3: one surviving record per group of duplicates, chosen field by field.

Each record is a point (trust, recency, completeness).  Records of a group with
equal trust and the same set of given fields are folded first to the best of
them, so a group has at most (trust levels x 2^fields) points however many
records it holds.  The points are peeled into dominance layers: the first is the
skyline (the Pareto-undominated points), the next the skyline of the rest, and
so on.  Inside a layer the policy decides: trust, recency, completeness, smallest
record.  The best point of the first layer is the base of the survivor; what it
leaves null is filled from the successive layers, each field from the first
layer that gives it.

Then a field is checked against the policy over all layers, as the layers may
give it from a less trusted record: of A (trust 1, 2024-05, no value), B (trust 1,
2024-01, a value) and C (trust 2, 2024-06, a value), B is behind A in layer 2 and C
is in layer 1, so the layers alone take C, the policy B.  Both are reported.

Defined results: records whose group key is missing belong to no group; unknown
statuses rank behind all known ones; records without a date are the earliest;
a field no record gives stays null; repeated record ids count as one point each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions.columns import pin
from lacuna.functions.text import is_missing

UNKNOWN_TRUST = 1 << 20
_SHIFT = 10**20
# English month names by their first three letters.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def written_date(text: Column) -> Column:
    """The date in a free text: 2024-01-31 (also with / or . or a time), 20240131, 31 January 2024, January 31, 2024; else null."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, f"{i + 1:02d}")])

    def made(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        m = F.regexp_extract(text, pattern, month)
        month_text = F.try_element_at(months, F.lower(F.substring(m, 1, 3))) if named else F.lpad(m, 2, "0")
        joined = F.concat_ws("-", F.regexp_extract(text, pattern, year), month_text, F.lpad(F.regexp_extract(text, pattern, day), 2, "0"))
        return F.when(F.regexp_extract(text, pattern, 0) != "", joined.try_cast("date"))

    name = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    return F.coalesce(
        made(r"(?<![0-9])((?:19|20)[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9])", 1, 2, 3),
        made(r"(?<![0-9])((?:19|20)[0-9]{2})(0[1-9]|1[0-2])([0-3][0-9])(?![0-9])", 1, 2, 3),
        made(rf"(?i)(?<![0-9])([0-9]{{1,2}})(?:st|nd|rd|th)?\.?\s+{name}\.?,?\s+((?:19|20)[0-9]{{2}})(?![0-9])", 3, 2, 1, named=True),
        made(rf"(?i)\b{name}\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)[0-9]{{2}})(?![0-9])", 3, 1, 2, named=True),
    )


def fold_points(records: DataFrame, group: Sequence[str], identity: str, trust: str, recency: str, fields: Sequence[str]) -> DataFrame:
    """One row per group of two or more records: ``group_id`` and its ``points`` in the order of the policy.

    A point is (trust, -day, -given, record, mask).
    """
    mask = sum((F.when(~is_missing(f), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    day = F.coalesce(F.unix_date(F.col(recency)).cast("long") + 1_000_000, F.lit(0))
    wide = "decimal(38,0)"
    # best of equal trust and mask: latest day, then smallest record, in one number that hash aggregation can hold
    code = day.cast(wide) * F.lit(str(_SHIFT)).cast(wide) + (F.lit(str((1 << 63) - 1)).cast(wide) - F.col(identity).cast(wide))
    rows = records.select(*group, F.col(identity).alias("_id"), F.coalesce(F.col(trust), F.lit(UNKNOWN_TRUST)).cast("int").alias("_trust"), mask.cast("int").alias("_mask"), code.alias("_code"))
    folded = rows.groupBy(*group, "_trust", "_mask").agg(F.max("_code").alias("_code"), F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    best_day = F.floor(F.col("_code") / F.lit(str(_SHIFT)).cast(wide)).cast("long")
    rest = F.pmod(F.col("_code"), F.lit(str(_SHIFT)).cast(wide))
    point = F.struct(
        F.col("_trust").alias("trust"),
        (-best_day).alias("minus_day"),
        (-F.bit_count("_mask")).alias("minus_given"),
        (F.lit(str((1 << 63) - 1)).cast(wide) - rest).cast("long").alias("record"),
        F.col("_mask").alias("mask"),
    )
    groups = folded.groupBy(*group).agg(F.sort_array(F.collect_list(point)).alias("points"), F.sum("_n").alias("records"), F.min("_first").alias("group_id"))
    return groups.where(F.col("records") > 1)


def _dominates(a: Column, b: Column) -> Column:
    no_worse = (a["trust"] <= b["trust"]) & (a["minus_day"] <= b["minus_day"]) & (a["minus_given"] <= b["minus_given"])
    return no_worse & ((a["trust"] < b["trust"]) | (a["minus_day"] < b["minus_day"]) | (a["minus_given"] < b["minus_given"]))


_LAYERED = "array<struct<layer:int,trust:int,minus_day:bigint,minus_given:int,record:bigint,mask:int>>"


def dominance_layers(points: Column) -> Column:
    """The points (in policy order) with their layer: 1 + the longest chain of points that dominate it."""

    def step(done: Column, p: Column) -> Column:
        # whatever dominates a point stands before it in policy order
        behind = F.array_max(F.transform(F.filter(done, lambda q: _dominates(q, p)), lambda q: q["layer"]))
        here = F.struct((F.coalesce(behind, F.lit(0)) + 1).alias("layer"), p["trust"].alias("trust"), p["minus_day"].alias("minus_day"), p["minus_given"].alias("minus_given"), p["record"].alias("record"), p["mask"].alias("mask"))
        return F.concat(done, F.array(here))

    return F.aggregate(points, F.array().cast(_LAYERED), step)


def skyline(layered: Column) -> Column:
    """The undominated points, in the order of the policy."""
    return F.filter(layered, lambda p: p["layer"] == 1)


def _gives(bit: int):
    return lambda p: p["mask"].bitwiseAND(F.lit(bit)) != 0


def _in_policy_order(p: Column) -> Column:
    return F.struct(p["trust"], p["minus_day"], p["minus_given"], p["record"], p["layer"].alias("layer"))


def choose_fields(records: DataFrame, group: Sequence[str], identity: str, trust: str, recency: str, fields: Sequence[str]) -> DataFrame:
    """One row per group and field given in it: group columns, group_id, base_record, field_name, record and its layer, layer_record (by the layers alone)."""
    groups = pin(fold_points(records, group, identity, trust, recency, fields), _layered=dominance_layers(F.col("points")))
    groups = groups.withColumn("base_record", skyline(F.col("_layered"))[0]["record"])
    filled = []
    for i, name in enumerate(fields):
        givers = F.filter("_layered", _gives(1 << i))
        # array_min compares layer, then policy; a point of the same layer and better policy always comes first
        filled.append(F.struct(F.lit(name).alias("field_name"), F.array_min(givers).alias("by_layers"), givers.alias("givers")))
    flat = groups.select(*group, "group_id", "base_record", F.explode(F.array(*filled)).alias("pick")).where(F.col("pick.by_layers").isNotNull())
    start = _in_policy_order(F.col("pick.by_layers"))
    better = F.filter("pick.givers", lambda p: (p["layer"] > F.col("pick.by_layers.layer")) & (_in_policy_order(p) < start))
    flat = flat.withColumn("_checked", F.coalesce(F.array_min(F.transform(better, _in_policy_order)), start))
    return flat.select(*group, "group_id", "base_record", F.col("pick.field_name").alias("field_name"), F.col("_checked.record").alias("record"), F.col("_checked.layer").alias("layer"), F.col("pick.by_layers.record").alias("layer_record"))


def build_survivors(records: DataFrame, group: Sequence[str], identity: str, trust: str, recency: str, fields: Sequence[str]) -> DataFrame:
    """One record per group of two or more: group_id, base_record, each field with the record and layer it came from and the record the layers alone give."""
    chosen = choose_fields(records, group, identity, trust, recency, fields)
    values = records.select(F.col(identity).alias("record"), *[F.col(f).alias(f"_v_{f}") for f in fields])
    joined = chosen.join(values, "record")
    cells = []
    for f in fields:
        here = F.col("field_name") == f
        pick = lambda c: F.max(F.when(here, F.col(c)))  # noqa: B023, E731
        cells += [pick(f"_v_{f}").alias(f), pick("record").alias(f"{f}_from"), pick("layer").alias(f"{f}_layer"), pick("layer_record").alias(f"{f}_by_layers")]
    return joined.groupBy("group_id").agg(F.min("base_record").alias("base_record"), *cells)
