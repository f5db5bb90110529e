"""Around the scoring of reads: where a group of sites lies among the events, the map of scored sites, the run's checks, and which file holds a read.

All are joins, windows per read and aggregates with partial forms; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.functions.signal import basename

LEAST_SPAN = 10


def event_bounds(pairs: DataFrame, groups: DataFrame, key: str, least_span: int = LEAST_SPAN) -> DataFrame:
    """First and last event of every group of sites that a read covers. pairs: key, i, ref_pos, event; groups: key, start, stop.

    Each end takes the first pair at or after it. A group goes if an end has none, if no pair lies at or before its
    start, or if its events are least_span or fewer apart. Pairs and ends are sorted together, last position first, so
    each end sees its pair in one running window and no ranges are joined."""
    ends = groups.withColumn("at", F.explode(F.array("start", "stop")))
    nothing = F.lit(None)
    rows = pairs.select(key, F.col("ref_pos").alias("at"), "i", F.struct("ref_pos", "event").alias("pair"), nothing.cast("bigint").alias("start"), nothing.cast("bigint").alias("stop")).unionByName(
        ends.select(key, "at", nothing.cast("bigint").alias("i"), "start", "stop"), allowMissingColumns=True
    )
    back = Window.partitionBy(key).orderBy(F.desc("at"), F.desc_nulls_last("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.select("*", F.last("pair", ignorenulls=True).over(back).alias("found"), F.min(F.col("pair.ref_pos")).over(Window.partitionBy(key)).alias("lowest"))
    of = lambda end: F.max(F.when(F.col("at") == F.col(end), F.col("found.event")))
    bounds = seen.where("start is not null").groupBy(key, "start", "stop").agg(of("start").alias("first_event"), of("stop").alias("last_event"), F.min("lowest").alias("lowest"))
    return bounds.where((F.col("lowest") <= F.col("start")) & (F.abs(F.col("last_event") - F.col("first_event")) > least_span)).drop("lowest")


def site_map(scores: DataFrame, key: str, order: str = "i") -> DataFrame:
    """Scored sites of each read: what describes a site comes from the first score, the likelihoods from the last, and all are counted. scores: key, start, end, num_motifs, sequence, ll_unmethylated, ll_methylated."""
    described = [F.min_by(c, order).alias(c) for c in ("end", "num_motifs", "sequence")]
    scored = [F.max_by(c, order).alias(c) for c in ("ll_unmethylated", "ll_methylated")]
    sites = scores.groupBy(key, "start").agg(*described, *scored, F.count("*").alias("strands_scored"))
    return sites.withColumn("log_lik_ratio", F.col("ll_methylated") - F.col("ll_unmethylated"))


def run_checks(totals: DataFrame) -> DataFrame:
    """What is wrong with a run, as a row of flags beside its counts. totals: total, bad_quality, bad_calibration, bad_alignment, missing, low_mapq."""
    failed = F.col("bad_quality") + F.col("bad_calibration") + F.col("bad_alignment")
    return totals.withColumns(
        {
            "warn_mapq": F.col("low_mapq") > F.col("total"),
            "warn_failed": failed > F.expr("total div 2"),
            "warn_missing": F.col("missing") * 10 > F.col("total"),
            "error_all_failed": failed + F.col("missing") >= F.col("total"),
            "error_empty": F.col("total") == 0,
        }
    )


def paths_of_reads(files: DataFrame, summary: DataFrame, reads: DataFrame) -> DataFrame:
    """The path of every known read: files by their base names to the reads a summary lists for them. files: path; summary: filename, read_id; reads: read_id."""
    named = files.select("path", basename(F.col("path")).alias("filename"))
    return named.join(summary.select("filename", "read_id"), "filename").join(reads.select("read_id"), "read_id", "left_semi").select("read_id", "path")
