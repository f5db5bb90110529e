"""Methylation frequency: aggregation of calls, merging of partial results, comparison.

Order-dependent semantics ("first seen") are min_by over a row number that the
source supplies, so results do not depend on partitioning; both aggregations
have partial forms, so a hot site costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglake.functions.signal import cpg_positions

SITE = ("chromosome", "start", "end")


def confident_calls(calls: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Calls with an absolute log-likelihood ratio of threshold or more."""
    return calls.where(F.abs("log_lik_ratio") >= threshold)


def clip_window(calls: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """Calls whose site lies in [start, end)."""
    return calls.where((F.col("chromosome") == chromosome) & (F.col("start") >= start) & (F.col("end") < end))


def split_groups(calls: DataFrame) -> DataFrame:
    """One row per CG of a call of several, at its own position, named split-group; calls of one stay."""
    several = F.col("num_motifs") > 1
    positions = cpg_positions(F.col("sequence"))
    at = F.explode(F.when(several, F.transform(positions, lambda p: p - F.element_at(positions, 1))).otherwise(F.array(F.lit(0))))
    out = calls.withColumn("at", at)
    return out.select(
        *[c for c in calls.columns if c not in ("start", "end", "num_motifs", "sequence")],
        F.when(several, F.col("start") + F.col("at")).otherwise(F.col("start")).alias("start"),
        F.when(several, F.col("start") + F.col("at")).otherwise(F.col("end")).alias("end"),
        F.when(several, 1).otherwise(F.col("num_motifs")).cast("bigint").alias("num_motifs"),
        F.when(several, "split-group").otherwise(F.col("sequence")).alias("sequence"),
    )


def site_frequency(calls: DataFrame, threshold: float = 2.5, split: bool = False) -> DataFrame:
    """Called and methylated motifs per site. calls: chromosome, start, end, log_lik_ratio, num_motifs, sequence, row_no."""
    calls = confident_calls(calls, threshold)
    if split:
        calls = split_groups(calls)
    out = calls.groupBy(*SITE).agg(
        F.min_by("num_motifs", "row_no").alias("num_motifs_in_group"),
        F.sum("num_motifs").alias("called_sites"),
        F.sum(F.when(F.col("log_lik_ratio") > 0, F.col("num_motifs")).otherwise(0)).alias("called_sites_methylated"),
        F.min_by("sequence", "row_no").alias("group_sequence"),
    )
    out = out.where("called_sites > 0")
    return out.select(*SITE, "num_motifs_in_group", "called_sites", "called_sites_methylated", (F.col("called_sites_methylated") / F.col("called_sites")).alias("methylated_frequency"), "group_sequence")


def merge_frequencies(files: list[DataFrame]) -> DataFrame:
    """Full outer merge of frequency tables by chromosome and start.

    The n-th row of a site in one file meets the n-th of the others. Sites of one file pass through; others are summed, with end and group size of the last file, and must agree in their sequence."""
    rows = None
    for k, f in enumerate(files):
        n = F.row_number().over(Window.partitionBy("chromosome", "start").orderBy("end", "group_sequence"))
        part = f.select("*", F.lit(k).alias("file"), n.alias("nth"))
        rows = part if rows is None else rows.unionByName(part)
    called, methylated = F.sum("called_sites"), F.sum("called_sites_methylated")
    alike = F.min("group_sequence").eqNullSafe(F.max("group_sequence"))
    return rows.groupBy("chromosome", "start", "nth").agg(
        F.max_by("end", "file").alias("end"),
        F.max_by("num_motifs_in_group", "file").alias("num_motifs_in_group"),
        called.alias("called_sites"),
        methylated.alias("called_sites_methylated"),
        F.when(F.count("*") == 1, F.min("methylated_frequency")).otherwise(methylated / called).alias("methylated_frequency"),
        F.when(alike, F.min("group_sequence")).otherwise(F.raise_error(F.lit("group sequences of a merged site differ"))).alias("group_sequence"),
    ).drop("nth")


def compare_frequencies(one: DataFrame, two: DataFrame) -> DataFrame:
    """Depth and frequency of sites of one motif that both tables have."""
    pick = lambda d, n: d.where("num_motifs_in_group = 1 and called_sites > 0").select(*SITE, F.col("called_sites").alias(f"depth_{n}"), F.col("methylated_frequency").alias(f"frequency_{n}"))
    return pick(one, 1).join(pick(two, 2), list(SITE))


def correlation(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), F.corr("frequency_1", "frequency_2").alias("r"))


def histogram_2d(compared: DataFrame, bins: int = 25) -> DataFrame:
    b = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return compared.groupBy(b("frequency_1").alias("bin_1"), b("frequency_2").alias("bin_2")).agg(F.count("*").alias("n"))


def accumulate_bedmethyl(rows: DataFrame) -> DataFrame:
    """bedMethyl rows (chromosome, start, strand, coverage, percent): both strands of a site as one, which ends where it starts."""
    at = F.col("start") - F.when(F.col("strand") == "-", 1).otherwise(0)
    methylated = ((F.col("percent") / 100) * F.col("coverage")).cast("bigint")
    site = rows.select("chromosome", at.alias("start"), at.alias("end"), "coverage", methylated.alias("methylated"))
    return site.groupBy(*SITE).agg(F.sum("coverage").alias("depth"), F.sum("methylated").alias("methylated"))


def ordered(freq: DataFrame) -> DataFrame:
    return freq.orderBy("chromosome", "start", "end")


def let(value: Column, body) -> Column:
    """body over value, which is computed once; a value named many times would be as many copies of its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def formatted(value: Column, digits: int) -> Column:
    """C's %.nf for absolute values under 10 ** 9 and up to 6 digits, or under 1 and up to 9: the exact binary value, half to even.

    The part before the point stands apart. What is behind it is, in units of 2 ** -30, a whole number, of which the product with 10 ** n is an exact bigint, and a rest. The rest times 10 ** n is under 10 ** n of these units and decides only ties, which it does exactly: a double's distance from a tie is far above the error of one product."""
    scale, unit = 10**digits, 1 << 30

    def rounded(x):
        before = F.floor(x["size"])
        part = (x["size"] - before) * unit
        whole = F.floor(part)
        return F.struct((before * scale + F.shiftright(whole * scale, 30)).alias("n"), ((whole * scale).bitwiseAND(unit - 1) - unit // 2 + (part - whole) * scale).alias("over"))

    def text(r):
        n = r["n"] + F.when((r["over"] > 0) | ((r["over"] == 0) & (r["n"] % 2 == 1)), 1).otherwise(0)
        return let(n, lambda n: F.concat(((n - n % scale) / scale).cast("bigint").cast("string"), F.lit("." if digits else ""), F.lpad((n % scale).cast("string"), digits, "0") if digits else F.lit("")))

    shown = let(F.struct(F.abs(value.cast("double")).alias("size")), lambda x: let(rounded(x), text))
    return F.when(F.isnan(value), "nan").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), shown))
