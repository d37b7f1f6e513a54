"""Views that the queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.operators.cells import accepted_cells
from lacuna.sources.tables import table

#: Held-out folds of a cell are drawn by a hash that both engines compute alike.
FOLDS = 5

SQL_CELLS = """
c AS (SELECT model_id, evaluation_id, suite_id, metric, value, normalized_score AS score FROM scores
      WHERE audit_status IN ('verified', 'parsed_primary_source') AND isfinite(normalized_score) AND model_id IS NOT NULL AND evaluation_id IS NOT NULL)
"""
SQL_FOLD = "CAST('0x' || substr(md5(model_id || '|' || evaluation_id), 1, 6) AS BIGINT) % 5"
#: Every cell predicted by the column mean of the folds it is not in.
SQL_PRED = f"""
{SQL_CELLS},
f AS (SELECT *, {SQL_FOLD} AS fold FROM c),
tr AS (SELECT a.evaluation_id, k.fold, avg(a.score) AS predicted, stddev_pop(a.score) AS dispersion, median(a.score) AS middle FROM f a JOIN (SELECT DISTINCT fold FROM f) k ON a.fold <> k.fold GROUP BY 1, 2),
p AS (SELECT f.model_id, f.evaluation_id, f.suite_id, f.metric, f.fold, f.score AS actual, tr.predicted, tr.dispersion, tr.middle FROM f JOIN tr USING (evaluation_id, fold))
"""
#: The same for ten repeats, each with folds of its own.
REPEATS = 10
SQL_REPEATS = f"""
{SQL_CELLS},
f AS (SELECT c.*, r, CAST('0x' || substr(md5(model_id || '|' || evaluation_id || '|' || r), 1, 6) AS BIGINT) % 5 AS fold FROM c, range({REPEATS}) t(r)),
tr AS (SELECT a.evaluation_id, a.r, k.fold, avg(a.score) AS predicted FROM f a JOIN (SELECT DISTINCT fold FROM f) k ON a.fold <> k.fold GROUP BY 1, 2, 3),
p AS (SELECT f.model_id, f.evaluation_id, f.suite_id, f.r, abs(f.score - tr.predicted) AS e FROM f JOIN tr USING (evaluation_id, r, fold))
"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return accepted_cells(table(spark, d, "scores"))


def with_fold(frame: DataFrame, folds: int = FOLDS) -> DataFrame:
    text = F.concat(F.col("model_id"), F.lit("|"), F.col("evaluation_id"))
    return frame.withColumn("fold", F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % folds)


def _others(folded: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """Each row once for every fold it is not in, as ``held``: the training rows of that fold."""
    held = F.explode(F.array(*[F.lit(i).cast("long") for i in range(folds)])).alias("held")
    return folded.select(*keys, "score", "fold", held).where(F.col("fold") != F.col("held"))


def predictions(spark: SparkSession, d: str, middle: bool = False) -> DataFrame:
    """Every cell predicted by the column mean of the folds it is not in: model_id, evaluation_id, suite_id, metric, fold, actual, predicted, dispersion (and their median as ``middle``)."""
    folded = with_fold(cells(spark, d))
    extra = [F.median("score").alias("middle")] if middle else []
    train = _others(folded, ["evaluation_id"]).groupBy("evaluation_id", F.col("held").alias("fold")).agg(F.avg("score").alias("predicted"), F.stddev_pop("score").alias("dispersion"), *extra)
    out = folded.join(train, ["evaluation_id", "fold"])
    return out.select("model_id", "evaluation_id", "suite_id", "metric", "fold", F.col("score").alias("actual"), "predicted", "dispersion", *(["middle"] if middle else []))


def repeated_errors(spark: SparkSession, d: str) -> DataFrame:
    """model_id, evaluation_id, suite_id, r, e: the error of every cell in each of ten repeats of the folds."""
    c = cells(spark, d).select("model_id", "evaluation_id", "suite_id", "score", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("r"))
    text = F.concat_ws("|", "model_id", "evaluation_id", F.col("r").cast("string"))
    folded = c.withColumn("fold", F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % FOLDS)
    train = _others(folded, ["evaluation_id", "r"]).groupBy("evaluation_id", "r", F.col("held").alias("fold")).agg(F.avg("score").alias("predicted"))
    return folded.join(train, ["evaluation_id", "r", "fold"]).select("model_id", "evaluation_id", "suite_id", "r", F.abs(F.col("score") - F.col("predicted")).alias("e"))
