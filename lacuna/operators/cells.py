"""The long table of observed cells: filters, checks, support core, axis statistics.

A cell is (model_id, evaluation_id, score); a missing cell is a missing row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.session import cut

ACCEPTED = ["verified", "parsed_primary_source"]
PERCENT_FLOOR, PERCENT_CEILING = -1.0, 101.0


class DuplicateCellError(ValueError):
    pass


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def accepted_cells(scores: DataFrame, statuses: Sequence[str] = tuple(ACCEPTED)) -> DataFrame:
    """Eligible observations with a finite normalised score as ``score``; filters reach the scan."""
    return scores.where(F.col("audit_status").isin(list(statuses)) & finite("normalized_score") & F.col("model_id").isNotNull() & F.col("evaluation_id").isNotNull()).select(
        "model_id", "evaluation_id", "suite_id", "metric", "value", F.col("normalized_score").alias("score")
    )


def require_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, or an error naming the first repeated key."""
    twice = rows.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(1).collect()
    if twice:
        raise DuplicateCellError("repeated cell: " + ", ".join(str(twice[0][k]) for k in keys))
    return rows


def support_core(cells: DataFrame, min_row: int, min_col: int, max_rounds: int = 1000) -> DataFrame:
    """The largest set of cells in which every model has ``min_row`` and every evaluation ``min_col`` cells.

    Both sides are tested on the same snapshot and dropped together until nothing changes; the result does not depend on the order.
    """
    now, n = cells, -1
    for _ in range(max_rounds):
        rows = now.groupBy("model_id").count().where(F.col("count") >= min_row).select("model_id")
        cols = now.groupBy("evaluation_id").count().where(F.col("count") >= min_col).select("evaluation_id")
        now = cut(now.join(rows, "model_id", "left_semi").join(cols, "evaluation_id", "left_semi"))
        left = now.count()
        if left == n or left == 0:
            return now
        n = left
    raise RuntimeError("the support core did not settle")


def density(cells: DataFrame) -> DataFrame:
    out = cells.agg(F.count(F.lit(1)).alias("observed"), F.countDistinct("model_id").alias("models"), F.countDistinct("evaluation_id").alias("evaluations"))
    return out.withColumn("density", F.round(F.col("observed") / F.nullif(F.col("models") * F.col("evaluations"), F.lit(0)), 6))


def column_moments(cells: DataFrame, floor: float = 1e-12, score: str = "score") -> DataFrame:
    """evaluation_id, n, mean, sd (population; 1 where below ``floor``)."""
    out = cells.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("raw_sd"))
    return out.withColumn("sd", F.when(F.col("raw_sd") < floor, 1.0).otherwise(F.col("raw_sd")))


def logit_percent(c: Column) -> Column:
    p = F.greatest(F.lit(0.5), F.least(F.lit(99.5), c)) / 100.0
    return F.ln(p / (1.0 - p))


def percent_of_logit(c: Column) -> Column:
    return 100.0 / (1.0 + F.exp(-c))


def percentage_columns(cells: DataFrame) -> DataFrame:
    return cells.groupBy("evaluation_id").agg(((F.min("score") >= PERCENT_FLOOR) & (F.max("score") <= PERCENT_CEILING)).alias("is_percentage"))


# How metrics are stated in native units.
SIGNED_METRICS = ["pearson_r", "mean_pearson_r", "weighted_kappa", "clustering_score"]
FRACTION_METRICS = ["auroc", "balanced_accuracy", "dice", "f1_score", "macro_ovr_auc", "top1_accuracy"]


def native_score(score: Column, metric: Column) -> Column:
    m = F.regexp_replace(F.lower(metric), "-", "_")
    return F.when(m.isin(SIGNED_METRICS), score / 50.0 - 1.0).when(m.isin(FRACTION_METRICS), score / 100.0).otherwise(score)


def normalised_score(value: Column, metric: Column) -> Column:
    m = F.regexp_replace(F.lower(metric), "-", "_")
    return F.when(m.isin(SIGNED_METRICS), (value + 1.0) * 50.0).when(m.isin(FRACTION_METRICS), value * 100.0).otherwise(value)
