"""Tables laid out so that a region, or a length, is a few partitions.

Alignments go to the smallest bin that holds them whole; bins of a level are
eight times as wide as those of the level below. A row is in one bin, and a
region is a range of bins on each level, so reading one needs no look back for
long alignments and no row is stored twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglake.operators.reads import in_region

#: Bits of the finest bins (1 MB of a reference), and the levels; the coarsest bins hold all positions below 2 ** 32.
FINEST, LEVELS = 20, 5
STEP = 3


def _shift(level: int, finest: int) -> int:
    return finest + STEP * level


def level_of(start: Column, end: Column, finest: int = FINEST) -> Column:
    """The finest level on which start to end, which is not included, lies in one bin."""
    last = F.greatest(end - 1, start)
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(F.shiftright(start, _shift(level, finest)) == F.shiftright(last, _shift(level, finest)), level).otherwise(out)
    return out


def write_by_region(alignments: DataFrame, path: str, finest: int = FINEST) -> None:
    """Alignments (contig, pos, ref_end, ...) as Parquet by contig, level and bin, in files of the rows of few bins each."""
    level = level_of(F.col("pos").cast("bigint"), F.col("ref_end").cast("bigint"), finest)
    rows = alignments.withColumn("level", level)
    bin_ = reduce(lambda out, k: F.when(F.col("level") == k, F.shiftright(F.col("pos").cast("bigint"), _shift(k, finest))).otherwise(out), range(LEVELS), F.lit(None).cast("bigint"))
    # dealt by range, so a bin with very many rows is several files
    rows.withColumn("bin", bin_).repartitionByRange("contig", "level", "bin", "pos").sortWithinPartitions("contig", "level", "bin", "pos").write.partitionBy("contig", "level", "bin").parquet(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int, end: int, finest: int = FINEST) -> DataFrame:
    """The alignments that overlap start to end of a contig, from the partitions that can hold them alone."""
    last = max(end - 1, start)
    bins = [(F.col("level") == k) & F.col("bin").between(start >> _shift(k, finest), last >> _shift(k, finest)) for k in range(LEVELS)]
    rows = spark.read.option("basePath", path).parquet(path).where((F.col("contig") == contig) & reduce(lambda a, b: a | b, bins))
    return in_region(rows, contig, start, end).drop("level", "bin")


def length_bins(reads: DataFrame, bin_size: int = 1000) -> DataFrame:
    """reads, each name and sequence once, with bin: the length rounded down to bin_size."""
    return reads.dropDuplicates(["read_id", "seq"]).withColumn("bin", (F.floor(F.length("seq") / bin_size) * bin_size).cast("bigint"))


def grouped_by_length(reads: DataFrame, bin_size: int = 1000, mode: str = "bins", low: int = 0, high: int = 0) -> DataFrame:
    """reads with file, the group of lengths they are written to; lengths in bases.

    bins: one per bin. limit: the bins below that of length high, which must be there. range: those from low to high, both included, as one. accumulate: for each bin that is there, all reads of shorter bins, so a read is in the file of every longer bin."""
    rows = length_bins(reads, bin_size)
    k = lambda c: (c / 1000).cast("bigint").cast("string")
    own = F.concat(k(F.col("bin")), F.lit("k_"), k(F.col("bin") + bin_size), F.lit("k"))
    if mode == "bins":
        return rows.withColumn("file", own)
    if mode == "range":
        return rows.where((F.col("bin") >= low) & (F.col("bin") <= high)).withColumn("file", F.lit(f"{low // 1000}k_{high // 1000}k"))
    if mode == "limit":
        if not rows.where(F.col("bin") == high).limit(1).count():
            raise ValueError(f"no reads of the bin of {high} bases")
        return rows.where(F.col("bin") < high).withColumn("file", own)
    if mode == "accumulate":
        tops = sorted(r["bin"] for r in rows.select("bin").distinct().collect())  # a number per bin there is: at most the longest read over bin_size
        longer = F.explode(F.filter(F.lit(tops), lambda t: t > F.col("bin")))
        return rows.select("*", longer.alias("top")).withColumn("file", F.concat(F.lit("0k_"), k(F.col("top")), F.lit("k"))).drop("top")
    raise ValueError(f"no such mode: {mode}")


def write_by_length(reads: DataFrame, path: str, **options) -> None:
    """FASTA lines, a folder per group of lengths, in one pass."""
    rows = grouped_by_length(reads, **options)
    rows.select("file", F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), "seq").alias("value")).write.partitionBy("file").text(path)


def take_bases(reads: DataFrame, budget: int, order: str = "ord") -> DataFrame:
    """The first reads, by order (not null), that together have budget bases at most; the first that goes over it ends them.

    A prefix sum in two steps: bases per range of rows, then, in the one range where the budget ends, per read. No window runs over all reads."""
    dealt = reads.repartitionByRange(order).groupBy(F.spark_partition_id().alias("range")).agg(F.min(order).alias("first"), F.sum(F.length("seq")).alias("bases"))
    ranges, before = sorted(dealt.collect(), key=lambda r: r["range"]), 0  # a row per range
    for k, r in enumerate(ranges):
        if before + r["bases"] > budget:
            break
        before += r["bases"]
    else:
        return reads
    cutting = F.col(order) >= F.lit(r["first"])
    if k + 1 < len(ranges):
        cutting &= F.col(order) < F.lit(ranges[k + 1]["first"])
    running = F.sum(F.length("seq")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # of one range
    part = reads.where(cutting).withColumn("_sum", running).where(F.col("_sum") + F.lit(before) <= budget).drop("_sum")
    return reads.where(F.col(order) < F.lit(r["first"])).unionByName(part)
