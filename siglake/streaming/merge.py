"""Methylation frequency that grows with every batch of calls, its state in files.

A batch becomes partial frequencies, sums that add up, which are written under
the batch's number and the range of their sites. A batch that is run again, as
after a failure, overwrites what it wrote, so nothing counts twice. Reading
merges the partial rows of a site; a part of the genome reads the ranges it lies
in alone. ``compact`` folds the batches so far into one, in a new folder.

Nothing is held in memory between batches; a batch costs the size of its own
calls, whatever has come before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.operators.frequency import SITE, confident_calls, split_groups

#: Bases of a range of sites.
RANGE = 1 << 20


def partial_frequency(calls: DataFrame, threshold: float = 2.5, split: bool = False) -> DataFrame:
    """Sums per site, with the first call by row_no for what the first seen decides."""
    calls = confident_calls(calls, threshold)
    calls = split_groups(calls) if split else calls
    methylated = F.sum(F.when(F.col("log_lik_ratio") > 0, F.col("num_motifs")).otherwise(0))
    first = F.min(F.struct("row_no", "num_motifs", "sequence"))
    return calls.groupBy(*SITE).agg(F.sum("num_motifs").alias("called"), methylated.alias("methylated"), first.alias("first"))


def add_batch(calls: DataFrame, batch: int, path: str, threshold: float = 2.5, split: bool = False) -> None:
    """Writes a batch's partial frequencies; the same batch again replaces them."""
    rows = partial_frequency(calls, threshold, split).withColumn("range", F.expr(f"start div {RANGE}"))
    rows.write.mode("overwrite").partitionBy("chromosome", "range").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    schema = "start bigint, end bigint, called bigint, methylated bigint, first struct<row_no: bigint, num_motifs: bigint, sequence: string>, batch bigint, chromosome string, range bigint"
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def merged_frequency(spark: SparkSession, path: str, chromosome: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The frequencies of all batches so far, of a region (start included, end not) if one is given. First seen is by batch, then by row_no."""
    rows = stored(spark, path)
    if chromosome is not None:
        rows = rows.where(F.col("chromosome") == chromosome)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            rows = rows.where((F.col("range") >= bound // RANGE) & (F.col("start") >= bound) if low else (F.col("range") <= (bound - 1) // RANGE) & (F.col("start") < bound))
    sums = rows.groupBy(*SITE).agg(F.sum("called").alias("called"), F.sum("methylated").alias("methylated"), F.min(F.struct("batch", "first")).alias("f")).where("called > 0")
    return sums.select(*SITE, F.col("f.first.num_motifs").alias("num_motifs_in_group"), F.col("called").alias("called_sites"), F.col("methylated").alias("called_sites_methylated"), (F.col("methylated") / F.col("called")).alias("methylated_frequency"), F.col("f.first.sequence").alias("group_sequence"))


def compact(spark: SparkSession, path: str, new_path: str, up_to: int) -> None:
    """All batches up to one as that one, in a new folder, and later ones as they are; a stream goes on there."""
    rows = stored(spark, path)
    old = rows.where(F.col("batch") <= up_to).groupBy(*SITE, "range").agg(F.sum("called").alias("called"), F.sum("methylated").alias("methylated"), F.min(F.struct("batch", "first")).alias("f"))
    old = old.select(*SITE, "called", "methylated", F.col("f.first").alias("first"), "range", F.lit(up_to).cast("bigint").alias("batch"))
    old.unionByName(rows.where(F.col("batch") > up_to)).write.partitionBy("batch", "chromosome", "range").parquet(new_path)


def stream_into(calls: DataFrame, path: str, checkpoint: str, threshold: float = 2.5, split: bool = False):
    """Starts a query that adds every batch of a stream of calls to path, over what is there."""
    write = lambda batch, number: add_batch(batch, number, path, threshold, split)
    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
