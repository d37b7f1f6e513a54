"""Estimators of missing cells in relational form: one row per (model, evaluation) asked for.

Cells stay long; pair statistics come from one self-join per axis that is
reduced to one row per pair of that axis before anything else is joined.
``asked`` holds the cells to estimate (model_id, evaluation_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lacuna.operators.cells import column_moments
from lacuna.operators.stats import overlap_pairs


def benchmark_mean(cells: DataFrame, asked: DataFrame) -> DataFrame:
    means = cells.groupBy("evaluation_id").agg(F.avg("score").alias("predicted"))
    return asked.join(means, "evaluation_id", "left")


def benchmark_median(cells: DataFrame, asked: DataFrame) -> DataFrame:
    medians = cells.groupBy("evaluation_id").agg(F.median("score").alias("predicted"))
    return asked.join(medians, "evaluation_id", "left")


def model_mean(cells: DataFrame, asked: DataFrame) -> DataFrame:
    rows = cells.groupBy("model_id").agg(F.avg("score").alias("_row"))
    cols = cells.groupBy("evaluation_id").agg(F.avg("score").alias("_col"))
    return asked.join(rows, "model_id", "left").join(cols, "evaluation_id", "left").withColumn("predicted", F.coalesce("_row", "_col")).drop("_row", "_col")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair seen from either side: target, other, with y the target's and x the other's moments."""
    one = pairs.select(F.col("a").alias("target"), F.col("b").alias("other"), "n", "r", "rmse", F.col("mx").alias("my"), F.col("my").alias("mx"), F.col("vx").alias("vy"), F.col("vy").alias("vx"), "cxy")
    two = pairs.select(F.col("b").alias("target"), F.col("a").alias("other"), "n", "r", "rmse", "my", "mx", "vy", "vx", "cxy")
    return one.unionByName(two)


def model_knn(cells: DataFrame, asked: DataFrame, k: int = 5, minimum: int = 3) -> DataFrame:
    """Mean over those of the k nearest models (RMSE over shared evaluations) that have the cell, else the column mean."""
    pairs = _both_ways(overlap_pairs(cells, "model_id", "evaluation_id", minimum)).select("target", "other", F.round("rmse", 9).alias("rmse"))
    near = pairs.withColumn("_p", F.row_number().over(Window.partitionBy("target").orderBy("rmse", "other"))).where(F.col("_p") <= k)
    given = cells.select(F.col("model_id").alias("other"), "evaluation_id", "score")
    votes = asked.join(near.select(F.col("target").alias("model_id"), "other"), "model_id").join(given, ["other", "evaluation_id"]).groupBy("model_id", "evaluation_id").agg(F.avg("score").alias("_vote"))
    cols = cells.groupBy("evaluation_id").agg(F.avg("score").alias("_col"))
    return asked.join(votes, ["model_id", "evaluation_id"], "left").join(cols, "evaluation_id", "left").withColumn("predicted", F.coalesce("_vote", "_col")).drop("_vote", "_col")


def bench_knn(cells: DataFrame, asked: DataFrame, k: int = 5, minimum: int = 5) -> DataFrame:
    """z-scores of the k most correlated evaluations, weighted by correlation (at least 0.01), else the column mean."""
    moments = column_moments(cells, 1e-8).select("evaluation_id", "mean", "sd")
    pairs = _both_ways(overlap_pairs(cells, "evaluation_id", "model_id", minimum)).where(F.col("r").isNotNull() & ~F.isnan("r")).select("target", "other", F.round("r", 9).alias("r"))
    top = pairs.withColumn("_p", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("r"), "other"))).where(F.col("_p") <= k)
    z = cells.join(moments, "evaluation_id").select(F.col("evaluation_id").alias("other"), "model_id", ((F.col("score") - F.col("mean")) / F.col("sd")).alias("z"))
    weight = F.greatest(F.col("r"), F.lit(0.01))
    votes = asked.join(top.select(F.col("target").alias("evaluation_id"), "other", "r"), "evaluation_id").join(z, ["other", "model_id"]).groupBy("model_id", "evaluation_id").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("_z"))
    return asked.join(votes, ["model_id", "evaluation_id"], "left").join(moments, "evaluation_id", "left").withColumn("predicted", F.col("mean") + F.col("sd") * F.coalesce("_z", F.lit(0.0))).drop("_z", "mean", "sd")


def regression(cells: DataFrame, asked: DataFrame, by: str = "evaluation_id", top_k: int = 5, min_r2: float = 0.2, minimum: int = 5) -> DataFrame:
    """R2-weighted mean of simple regressions on the best ``top_k`` other evaluations (or models); null where none serves."""
    across = "model_id" if by == "evaluation_id" else "evaluation_id"
    pairs = _both_ways(overlap_pairs(cells, by, across, minimum))
    usable = (F.col("vy") * F.col("n") >= 1e-10) & (F.col("vx") * F.col("n") >= 1e-10)
    slope = F.col("cxy") / F.col("vx")
    fits = pairs.where(usable).select("target", "other", F.round(F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy")), 9).alias("r2"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
    best = fits.withColumn("_p", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("r2"), "other"))).where((F.col("_p") <= top_k) & (F.col("r2") >= min_r2))
    enough = cells.groupBy(by).count().where(F.col("count") >= minimum).select(F.col(by).alias("target"))
    best = best.join(enough, "target", "left_semi")
    given = cells.select(F.col(by).alias("other"), across, "score")
    votes = asked.join(best.withColumnRenamed("target", by), by).join(given, ["other", across]).groupBy("model_id", "evaluation_id")
    votes = votes.agg((F.sum(F.col("r2") * (F.col("slope") * F.col("score") + F.col("intercept"))) / F.sum("r2")).alias("predicted"))
    return asked.join(votes, ["model_id", "evaluation_id"], "left")
