"""Alignments, reads, regions and indexes: filters, joins and bookkeeping.

Joins on read_id are plain equi-joins: Spark shuffles both sides once, or
broadcasts a side whose size it knows to be small. A region list is a stated
query set; regions are dealt into bins so that the overlap join is an equi-join
on the bin with a residual, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flag bits of alignments and of read status.
UNMAPPED, SECONDARY, REVERSE, SUPPLEMENTARY = 0x4, 0x100, 0x10, 0x800
FAILED_CALIBRATION, FAILED_ALIGNMENT, FAILED_QUALITY = 1, 2, 4


def usable(min_mapq: int = 20) -> Column:
    return (F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("mapq") >= min_mapq)


def primary(alignments: DataFrame, min_mapq: int = 20, secondary: bool = False) -> DataFrame:
    """Mapped alignments of enough quality; secondary ones only on request, supplementary ones always."""
    out = alignments.where(usable(min_mapq))
    return out if secondary else out.where(F.col("flag").bitwiseAND(SECONDARY) == 0)


def filter_counts(alignments: DataFrame, min_mapq: int = 20) -> DataFrame:
    """One pass over all alignments: how many are kept, and why others are not."""
    good, second = usable(min_mapq), F.col("flag").bitwiseAND(SECONDARY) != 0
    return alignments.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("mapq") < min_mapq).alias("skip_mapq"),
        F.count_if((F.col("mapq") >= min_mapq) & ~good).alias("unmapped"),
        F.count_if(good & second).alias("secondary"),
        F.count_if(good & ~second).alias("kept"),
    )


def split_long(reads: DataFrame, threshold: int = 100_000) -> tuple[DataFrame, DataFrame]:
    long = F.length("seq") > threshold
    return reads.where(~long), reads.where(long)


def with_reads(alignments: DataFrame, reads: DataFrame, value: Column | None = None, name: str = "seq", missing: object = "") -> DataFrame:
    """Alignments with their read's sequence, or a value of it, which is made before the join so that it alone is shuffled; missing where the read is."""
    values = reads.select("read_id", (F.col("seq") if value is None else value).alias(name))
    return alignments.join(values, "read_id", "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def with_paths(alignments: DataFrame, index: DataFrame, on_missing: str = "skip") -> DataFrame:
    """Alignments with the path of their read's signal, from an index with a row per read (read_id, path). A read without a path, or with an empty one, is skipped, kept with none (keep), so that it can be counted, or ends the job (abort)."""
    if on_missing not in ("skip", "keep", "abort"):
        raise ValueError(f"on_missing is skip, keep or abort, not {on_missing}")
    known = index.where("path <> ''").select("read_id", "path")
    if on_missing == "skip":
        return alignments.join(known, "read_id")
    out = alignments.join(known, "read_id", "left")
    if on_missing == "abort":
        missing = F.raise_error(F.concat(F.lit("no signal path for read "), F.coalesce(F.col("read_id").cast("string"), F.lit("null"))))
        out = out.withColumn("path", F.when(F.col("path").isNull(), missing).otherwise(F.col("path")))
    return out


def missing_reads(alignments: DataFrame, reads: DataFrame) -> DataFrame:
    return alignments.select("read_id").distinct().join(reads, "read_id", "left_anti")


def first_reads(reads: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Of reads with one name the first in file order."""
    return reads.withColumn("_k", F.row_number().over(Window.partitionBy("read_id").orderBy(ordinal))).where("_k = 1").drop("_k")


def last_paths(paths: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Of signal paths given for a read the last."""
    return paths.groupBy("read_id").agg(F.max_by("path", ordinal).alias("path"))


def in_region(alignments: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    return alignments.where((F.col("contig") == contig) & (F.col("pos") < end) & (F.col("ref_end") > start))


def in_regions(alignments: DataFrame, regions: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Alignments of every region; one that overlaps several comes once for each. Regions: contig, r_start, r_end."""
    regions = regions.where("r_end >= r_start").withColumn("bin", F.explode(F.expr(f"sequence(r_start div {bin_size}, greatest(r_start, r_end - 1) div {bin_size})")))
    binned = alignments.withColumn("bin", F.explode(F.expr(f"sequence(pos div {bin_size}, greatest(pos, ref_end - 1) div {bin_size})")))
    first = F.greatest(F.col("pos"), F.col("r_start")) - F.col("bin") * bin_size
    joined = binned.join(regions, ["contig", "bin"]).where((F.col("pos") < F.col("r_end")) & (F.col("ref_end") > F.col("r_start")))
    return joined.where((first >= 0) & (first < bin_size)).drop("bin")  # a pair counts in the bin where its overlap begins


def tiled(reference: DataFrame, tile: int, overlap: int) -> DataFrame:
    """contig, tile_start, seq of overlapping tiles, so that a long contig is many rows."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(tile)))
    return reference.select("contig", starts.alias("tile_start"), "seq").select("contig", "tile_start", F.substring("seq", F.col("tile_start") + 1, F.lit(tile + overlap)).alias("seq"))


def crowded_files(summary: DataFrame, least_count: int = 20, fallback: int = 4000) -> DataFrame:
    """Files with more reads than the usual number, which is the mode of reads per file, or the fallback if few files share it."""
    per = summary.groupBy("filename").agg(F.count("*").alias("n"))
    mode = per.groupBy("n").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "n").limit(1)
    limit = mode.select(F.when(F.col("files") > least_count, F.col("n")).otherwise(fallback).alias("most"))
    return per.join(F.broadcast(limit), F.col("n") > F.col("most")).select("filename", "n")  # one row


def length_histogram(reads: DataFrame, bin_size: int = 1000) -> DataFrame:
    d = reads.dropDuplicates(["read_id", "seq"])
    return d.groupBy(F.floor(F.length("seq") / bin_size).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("bigint").alias("bases"))


def read_status(stats: DataFrame) -> DataFrame:
    """Status bits per read. stats: n_events, n_bases, avg_emission, max_gap, spans, n_match, var, events_per_base."""
    crowded = F.col("n_events") / F.col("n_bases") >= 15
    unaligned = crowded | (F.col("avg_emission") < -5) | (F.col("max_gap") > 50) | ~F.col("spans")
    calibration = ~unaligned & ((F.col("n_match") < 200) | (F.col("var") > 2.5))
    quality = ~unaligned & ~calibration & (F.col("events_per_base") > 5.0)
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return stats.withColumn("status", bit(calibration, FAILED_CALIBRATION) + bit(unaligned, FAILED_ALIGNMENT) + bit(quality, FAILED_QUALITY))
