"""Problem 7: gaps filled from the nearest similar record of the same group (sequential hot deck).

Records are sorted within their group; a gap takes the value of the nearest
donor before or after it, by distance along the sort key, and keeps the donor,
its side and its distance.  Equal distances go to the donor before.

A group may hold a third of all rows, so a group is never one window: the whole
order of groups, sort keys and identities is cut by range into as many even
slices as the session shuffles into, windows run inside a slice of a group, and
the last and first donor of each, found by a plain aggregate, are carried over to
the slices after and before it.  Records of no group take no part.

Defined results: null groups are never filled and never donate; records without
a sort key stand before all others of their group and have a null distance;
repeated records are filled alike; a group without donors stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lacuna.session import cut


def hot_deck(rows: DataFrame, group: str, order: str, identity: str, value: str) -> DataFrame:
    """Adds ``<value>_filled``, ``was_filled``, ``donor``, ``donor_side`` and ``distance`` (in units of ``order``).

    ``order`` is numeric (or null), ``identity`` breaks ties and names the donor;
    a record takes no value of its own identity.
    """
    kind, names = dict(rows.dtypes)[value], rows.columns
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.where(F.col(group).isNotNull()).withColumn("_at", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    base = cut(grouped.repartitionByRange(pieces, group, "_at", identity).withColumn("_slice", F.spark_partition_id()))  # cut, so that slices stay as they are
    donor = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(identity).alias("who"), F.col(value).alias("what")))
    base = base.withColumn("_donor", donor)

    inside = Window.partitionBy(group, "_slice").orderBy("_at", identity)
    base = base.withColumn("_prev", F.last("_donor", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    base = base.withColumn("_next", F.first("_donor", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)))

    edges = base.where(F.col("_donor").isNotNull() | F.col(value).isNull()).groupBy(group, "_slice").agg(F.max("_donor").alias("_last"), F.min("_donor").alias("_first"))
    across = Window.partitionBy(group).orderBy("_slice")
    edges = edges.withColumn("_from_before", F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.withColumn("_from_after", F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)))
    edges = edges.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_from_before", "_from_after")
    base = base.join(edges, (F.col(group) == F.col("_g")) & (F.col("_slice") == F.col("_s")), "left").drop("_g", "_s")

    before, after = F.coalesce("_prev", "_from_before"), F.coalesce("_next", "_from_after")
    gap_before, gap_after = F.col("_at") - before["at"], after["at"] - F.col("_at")
    use_before = before.isNotNull() & (after.isNull() | (gap_before <= gap_after))
    chosen = F.when(F.col(value).isNull(), F.when(use_before, before).otherwise(after))
    base = base.withColumn("_chosen", chosen)
    steps = F.abs(F.col("_at") - F.col("_chosen")["at"])
    filled = (
        base.withColumn(f"{value}_filled", F.coalesce(F.col(value), F.col("_chosen")["what"]).cast(kind))
        .withColumn("was_filled", F.col(value).isNull() & F.col("_chosen").isNotNull())
        .withColumn("donor", F.col("_chosen")["who"])
        .withColumn("donor_side", F.when(F.col("_chosen").isNotNull(), F.when(use_before, "before").otherwise("after")))
        .withColumn("distance", F.when(steps < float("inf"), steps))
        .drop("_slice", "_at", "_donor", "_prev", "_next", "_from_before", "_from_after", "_chosen")
    )
    out = [f"{value}_filled", "was_filled", "donor", "donor_side", "distance"]
    types = dict(filled.dtypes)
    alone = rows.where(F.col(group).isNull()).select(
        *names, F.col(value).alias(out[0]), F.lit(False).alias(out[1]), *[F.lit(None).cast(types[c]).alias(c) for c in out[2:]]
    )
    return filled.select(*names, *out).unionByName(alone)
