"""Ranks and running sums without one window over all rows.

Rows are cut into buckets that follow the order; a plain aggregate counts each
bucket, a window over the few buckets gives the offsets, and windows inside the
buckets do the rest.  A group with a third of all rows is thus spread over all
tasks, as are equal values, which are counted before they are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.session import cut

BUCKET_ROWS = 200_000


def hash_bits(rows: int) -> int:
    """Leading bits of a hash that cut so many rows into buckets of about ``BUCKET_ROWS``; at least 10."""
    return min(24, max(10, (rows // BUCKET_ROWS).bit_length()))


def hash_bucket(h: Column, bits: int = 10) -> Column:
    """The leading bits of a 64-bit hash, in the order of the hash."""
    return F.shiftright(h, 64 - bits)


def running(rows: DataFrame, group: Sequence[str], order: str, ties: Sequence[str], amount: Column | None = None, out: str = "place", bits: int = 10) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` (1 if none) over the rows of the group up to and with this one, in the order of a 64-bit hash column.

    ``bits``: of :func:`hash_bits` where the number of rows is known.
    """
    what = F.lit(1) if amount is None else amount
    rows = rows.withColumn("_bucket", hash_bucket(F.col(order), bits)).withColumn("_amount", what.cast("long"))
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_amount").over(inside))
    return local.join(offsets, [*group, "_bucket"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_bucket", "_amount")


def value_counts_below(rows: DataFrame, group: str, value: str, pieces: int = 128) -> DataFrame:
    """One row per group and value: ``n`` rows have it, ``below`` rows have less, ``total`` rows are in the group.

    Null values are left out.  Each group's order is cut at approximate quantiles.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, at, 10_000).alias("_cuts"), F.sum("n").alias("total"))
    counts = counts.join(cuts, group)
    counts = counts.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    sums = counts.groupBy(group, "_bucket").agg(F.sum("n").alias("_sum"))
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, [group, "_bucket"]).withColumn("below", F.col("_local") + F.col("_before")).drop("_local", "_before", "_bucket")


def counts_below(rows: DataFrame, value: str) -> DataFrame:
    """``value_counts_below`` of a table that is one group: value, n, below, total.

    Distinct values are cut by range into as many pieces as the session shuffles into; only a sum per piece is
    carried over, so nothing is joined but that short table.
    """
    spark = rows.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counts.repartitionByRange(pieces, value).withColumn("_bucket", F.spark_partition_id()))  # cut, so that pieces stay as they are
    before, offsets = 0, []
    for r in ranged.groupBy("_bucket").agg(F.sum("n").alias("s")).orderBy("_bucket").collect():  # a row per piece
        offsets.append((r["_bucket"], before))
        before += r["s"]
    table = spark.createDataFrame(offsets, "_bucket int, _before long")
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(F.broadcast(table), "_bucket").select(value, "n", (F.col("_local") + F.col("_before")).alias("below"), F.lit(before).cast("long").alias("total"))
