"""Incremental methylation frequency with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siglake.operators.frequency import site_frequency


def stream_frequency(calls: DataFrame, threshold: float = 2.5, split: bool = False) -> DataFrame:
    """The streaming aggregate of a stream of calls; its state is a row per site. Write it in complete or update mode."""
    return site_frequency(calls, threshold, split)


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir; a temporary one only where Spark runs in one process and none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/siglake-stream-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share, or give a checkpoint")
    return tempfile.mkdtemp()


def run_available(spark: SparkSession, calls: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream of calls over what is there and returns the sites as a table in memory. For tests and small results; write large ones with writeStream to a table."""
    q = stream_frequency(calls).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint or checkpoint_folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
