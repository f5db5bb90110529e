"""Slices of reference sequences for alignments, by a join on tiles.

A reference is rows of (contig, start, seq), of any lengths: whole contigs, or
the lines of a FASTA file with their offsets. What alignments lie on is cut into
tiles of one size, so a long contig is spread over many keys. Tiles stand in
bins of several sizes, each in two that follow each other, so an alignment lies
in one bin of its own size, and its bases come from one row: they are cut out
behind the join and never shuffled, nor is anything but the alignment's own
columns. A bin under very many alignments is one row on its side, which AQE
splits the other side's rows against, and a small reference is broadcast after
its bases were counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.sources.shared import checked_broadcast, shared_folder

TILE = 1 << 14
#: Bases that may be broadcast.
BROADCAST_BASES = 64 << 20
#: Bins of one level are so many times as wide as those below.
WIDER = 8


def placed_lines(lines: DataFrame) -> DataFrame:
    """contig, start, seq of the lines of each contig (contig, ord, seq), in their order. Offsets are running sums in pieces of 4096 lines, then over the pieces of a contig, so no window holds a contig's lines."""
    w = Window.partitionBy("contig", "piece").orderBy("ord")
    rows = lines.select("contig", "ord", "seq", F.expr("ord div 4096").alias("piece"))
    pieces = rows.groupBy("contig", "piece").agg(F.sum(F.length("seq")).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("contig").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("contig", "piece", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(F.length("seq")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(pieces, ["contig", "piece"]).select("contig", (F.col("before") + F.col("inside")).alias("start"), "seq")


def tiles(reference: DataFrame, tile: int = TILE) -> DataFrame:
    """contig, tile, seq: the bases of each tile, from reference rows (contig, start, seq) that don't overlap."""
    rows = reference.where("seq <> ''").withColumn("start", F.col("start").cast("bigint"))
    last = F.col("start") + F.length("seq") - 1
    cut = rows.withColumn("tile", F.explode(F.sequence(F.expr(f"start div {tile}"), F.floor(last / tile))))
    low = F.greatest(F.col("tile") * tile - F.col("start"), F.lit(0))
    high = F.least((F.col("tile") + 1) * tile - F.col("start"), F.length("seq").cast("bigint"))
    parts = cut.select("contig", "tile", (F.col("start") + low).alias("at"), F.col("seq").substr((low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("contig", "tile").agg(F.min("at").alias("at"), whole.alias("seq"))


def extents(alignments: DataFrame) -> DataFrame:
    """contig, first, last and longest: between which places of a contig alignments (contig, pos, ref_end) lie, and how far the longest reaches."""
    low, high = (F.greatest(F.col(c), F.lit(0)).cast("bigint") for c in ("pos", "ref_end"))
    return alignments.groupBy("contig").agg(F.min(low).alias("first"), F.max(high).alias("last"), F.max(high - low).alias("longest"))


def reference_slices(alignments: DataFrame, reference: DataFrame, key: list[str], tile: int = TILE, asked: DataFrame | None = None) -> DataFrame:
    """key and ref_seq, the bases from pos to ref_end, which is included, as far as the contig goes; empty beyond its end, null where the contig is unknown. alignments: key, contig, pos, ref_end; reference: contig, start, seq; asked: extents that hold those of alignments, if these are dear to read twice."""
    spark = reference.sparkSession
    path = shared_folder(spark, "extents")
    (extents(alignments) if asked is None else asked).write.parquet(path)
    asked = spark.read.parquet(path)
    longest = asked.agg(F.max("longest")).first()[0] or 0
    path = shared_folder(spark, "tiles")
    within = reference.join(checked_broadcast(asked), "contig").where(F.expr("start <= last and start + length(seq) > first"))
    tiles(within.select("contig", "start", "seq"), tile).write.parquet(path)  # cut once, whatever is counted and joined afterwards
    cut = spark.read.parquet(path)
    widths = [tile]
    while widths[-1] <= longest:
        widths.append(widths[-1] * WIDER)
    bins = ", ".join(f"named_struct('level', {k}, 'bin', tile * {tile} div {w} - {j})" for k, w in enumerate(widths) for j in (0, 1))
    bases, wide_letters = cut.agg(F.sum(F.length("seq")), F.max(F.expr("octet_length(seq) > length(seq)"))).first()
    part = F.struct("tile", "at", "seq" if wide_letters else F.col("seq").cast("binary").alias("seq"))  # one byte a base: places are found without counting letters
    wide = cut.select("contig", F.expr(f"inline(array({bins}))"), part.alias("part")).groupBy("contig", "level", "bin").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    wide = F.broadcast(wide) if 2 * len(widths) * (bases or 0) <= BROADCAST_BASES else wide
    sizes = reference.select("contig", (F.col("start") + F.length("seq")).alias("end"))
    known = sizes.groupBy("contig").agg(F.max("end").alias("size"))
    spans = alignments.select(*dict.fromkeys([*key, "contig"]), F.greatest(F.col("pos"), F.lit(0)).cast("bigint").alias("low"), F.greatest(F.col("ref_end"), F.lit(0)).cast("bigint").alias("high"))
    spans = spans.join(checked_broadcast(known), "contig", "left").withColumn("high", F.least("high", F.col("size") - 1))
    at = lambda value: "CASE " + " ".join(f"WHEN low > high THEN null WHEN high - low < {w} THEN {value(k, w)}" for k, w in enumerate(widths)) + " END"
    spans = spans.withColumns({"level": F.expr(at(lambda k, w: k)), "bin": F.expr(at(lambda k, w: f"low div {w}"))})
    found = spans.join(wide, ["contig", "level", "bin"], "left")
    inside = f"filter(parts, x -> x.tile between low div {tile} and high div {tile})"
    piece = "substring(x.seq, cast(greatest(low - x.at, 0) + 1 as int), cast(greatest(high - greatest(low, x.at) + 1, 0) as int))"
    return found.select(*key, F.expr(f"CASE WHEN size IS NOT NULL THEN coalesce(array_join(transform({inside}, x -> cast({piece} as string)), ''), '') END").alias("ref_seq"))
