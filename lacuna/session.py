"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lacuna")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset the session must be local: a cluster has to name a
    folder that all executors share, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lacuna-checkpoint-")  # local master only
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and go on from the files, so that a lost executor costs no recomputation.

    Spark removes the files of frames that are no longer referenced where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as local sessions here do.
    """
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame) -> DataFrame:
    """The same rows over enough tasks for work in Python, which file splits by size may not give; left alone where they do."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(3 * cores) if frame.rdd.getNumPartitions() < 2 * cores else frame
