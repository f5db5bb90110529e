"""Folders that all executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may have this many rows at most; callers state a width of under 200 bytes.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where Spark runs in one process and none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share, or give a path")
        shared = "file://" + tempfile.mkdtemp(prefix="siglake-")
    return f"{shared.rstrip('/')}/siglake-{name}-{uuid.uuid4().hex}"


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting; beyond max_rows the join stays a shuffled one."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
