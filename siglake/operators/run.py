"""A run over alignments that writes what it keeps and counts, on the way, what it doesn't.

The counters are observed on the one pass that filters, gates and writes, so no
second scan is needed for the report or the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siglake.operators.calling import run_checks
from siglake.operators.reads import FAILED_ALIGNMENT, FAILED_CALIBRATION, FAILED_QUALITY, SECONDARY, usable

COUNTERS = "total low_mapq unmapped secondary long missing bad_calibration bad_alignment bad_quality written bases".split()


def outcome(min_mapq: int = 20, secondary: bool = False, long: int | None = None) -> Column:
    """What becomes of an alignment: flag, mapq, n_bases, n_samples (null without a signal), status. The first reason in this order; written if there is none."""
    failed = lambda bit: F.col("status").bitwiseAND(bit) != 0
    good = usable(min_mapq)
    reasons = [
        ("low_mapq", ~good & (F.col("mapq") < min_mapq)), ("unmapped", ~good), ("secondary", F.lit(not secondary) & (F.col("flag").bitwiseAND(SECONDARY) != 0)),
        ("long", F.lit(False) if long is None else F.col("n_bases") > long), ("missing", F.coalesce("n_samples", F.lit(0)) <= 0),
        ("bad_calibration", failed(FAILED_CALIBRATION)), ("bad_alignment", failed(FAILED_ALIGNMENT)), ("bad_quality", failed(FAILED_QUALITY)),
    ]
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return F.coalesce(out, F.lit("written"))


def gate(rows: DataFrame, observed: Observation, min_mapq: int = 20, secondary: bool = False, long: int | None = None) -> DataFrame:
    """The rows that pass; observed gets the counters of all rows when they are written. total counts the rows that were taken up: all but those with low quality, unmapped and secondary ones; bases are those of the rows of them that have a signal and aren't too long."""
    d = rows.withColumn("_outcome", outcome(min_mapq, secondary, long))
    n = lambda name: F.coalesce(F.count_if(F.col("_outcome") == name), F.lit(0)).alias(name)
    taken = ~F.col("_outcome").isin("low_mapq", "unmapped", "secondary")
    loaded = taken & ~F.col("_outcome").isin("long", "missing")
    bases = F.coalesce(F.sum(F.when(loaded, F.col("n_bases"))), F.lit(0)).cast("bigint")
    d = d.observe(observed, F.count_if(taken).alias("total"), *[n(c) for c in COUNTERS[1:-1]], bases.alias("bases"))
    return d.where("_outcome = 'written'").drop("_outcome")


def run(rows: DataFrame, path: str, strict: bool = False, **options) -> DataFrame:
    """Writes the rows that pass as Parquet, and gives the run's counters and checks as a row. strict: a run that took up no reads, or whose reads all failed, is an error."""
    observed = Observation()
    gate(rows, observed, **options).write.parquet(path)
    counts = observed.get
    spark = rows.sparkSession
    out = run_checks(spark.createDataFrame([tuple(int(counts[c]) for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS)))
    if strict:
        found = out.first()
        if found["error_empty"]:
            raise RuntimeError("0 reads processed")
        if found["error_all_failed"]:
            raise RuntimeError(f"all {found['total']} reads failed")
    return out
