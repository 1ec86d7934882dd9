"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep splitting hot join keys even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # what an execution shuffled leaves the disk when it ends; a job of many writes holds one step's files at a time
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts stay with the cluster."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Rows that a task meets at most, about; beyond that there are more tasks, not larger ones.
ROWS_IN_TASK = 1_000_000
_TASKS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let a shuffle of ``rows`` start with so many partitions that the memory of a task, and so what it
    spills, does not grow with the table; small ones are coalesced again. Never fewer than the session has."""
    tasks = rows // ROWS_IN_TASK + 1
    if tasks > int(spark.conf.get(_TASKS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_TASKS, tasks)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; made up only for a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master == "local" or context.master.startswith("local["):  # one machine, one process
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Unlike a recomputed plan the copy survives lost executors, and its known size lets
    later joins pick a broadcast only where the table really is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
