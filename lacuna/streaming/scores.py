"""Score files as a stream: late and repeated observations within a watermark, support counts by evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_score_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, time: str = "reported_at", lateness: str = "30 days", keys: tuple[str, ...] = ("model_id", "evaluation_id", "metric")) -> DataFrame:
    """First observation of each cell within the watermark; rows later than that are dropped by the engine."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_support(stream: DataFrame, time: str = "reported_at", window: str = "30 days") -> DataFrame:
    """Observations and distinct models (approximate) per evaluation and event-time window."""
    return stream.groupBy(F.window(time, window).alias("w"), "evaluation_id").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("model_id").alias("models"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs all available input into an in-memory table (tests and small sinks)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
