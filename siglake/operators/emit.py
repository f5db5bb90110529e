"""Output lines of event alignment and of signal-to-read mapping: tables, PAF and SAM.

Everything of a read is made by windows and groups on the read's key, which one
exchange serves; a read's path is the only thing gathered, in one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglake.functions.signal import standardised_level
from siglake.operators.frequency import formatted, let
from siglake.operators.signals import collapse_raw

#: Column names of the tables.
EVENTALIGN = "contig position reference_kmer read_name strand event_index event_level_mean event_stdv event_length model_kmer model_mean model_stdv standardized_level".split()
M6ANET = "contig position reference_kmer read_name event_level_mean event_stdv event_length".split()
SUMMARY = "read_index read_name fast5_path model_name strand num_events num_steps num_skips num_stays total_duration shift scale drift var".split()
INDEXED = ["start_idx", "end_idx"]
NO_MAPQ = 255


def printed(value: Column, digits: int) -> Column:
    """C's %.nf, infinities and NaN included."""
    odd = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.coalesce(odd, formatted(F.when(odd.isNull(), value), digits))


def _line(*columns) -> Column:
    return F.concat_ws("\t", *columns)


def _joined(order: str, piece: str) -> Column:
    """All pieces of a key in order as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "")


def general(value: Column) -> Column:
    """C's %g of a single-precision value: six significant digits without trailing zeros, with an exponent from 10 ** 6 on and below 10 ** -4.

    A single's 24 bits times a power of ten up to 10 ** 9, which has 21 besides its twos, are exact in a double, so rounding to six digits is. Beyond that, with an exponent, the power is off by a double's error."""
    x = value.cast("float").cast("double")
    size = F.abs(x)
    decade = F.when((size >= 1e6) | (size < 1e-4), F.floor(F.log10(size)).cast("int"))
    for e in range(5, -5, -1):
        decade = decade.when(size >= 10.0**e, e)

    def text(r):
        n, e = r["n"], r["e"]
        n, e = F.when(n == 1_000_000, 100_000).otherwise(n), F.when(n == 1_000_000, e + 1).otherwise(e)
        plain = (e >= -4) & (e < 6)
        # six digits with the point behind the first, or where the number has it
        digits = F.concat(F.repeat(F.lit("0"), F.when(plain, F.greatest(-e, F.lit(0))).otherwise(0)), n.cast("string"))
        ahead = F.when(plain, F.greatest(e, F.lit(0)) + 1).otherwise(1)
        number = F.regexp_replace(F.concat(F.substring(digits, F.lit(1), ahead), F.lit("."), F.substring(digits, ahead + 1, F.lit(20))), r"[.]?0*$", "")
        mark = F.when(plain, "").otherwise(F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0")))
        return F.concat(F.when(r["x"] < 0, "-").otherwise(""), number, mark)

    held = lambda e: F.struct(x.alias("x"), e.alias("e"), F.rint(F.when(e <= 5, size * F.pow(F.lit(10.0), 5 - e)).otherwise(size / F.pow(F.lit(10.0), e - 5))).cast("bigint").alias("n"))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").otherwise(let(decade, lambda e: let(held(e), text)))


def scaled_to_model(rows: DataFrame, scale_events: bool) -> DataFrame:
    """Levels in units of the model (scale_events), or the model in units of the read. rows: level, model_mean, model_stdv, hmm_state, shift, scale, var. In state B there is no model: zeros."""
    blank = F.col("hmm_state") == "B"
    if scale_events:
        mean, stdv = F.col("model_mean"), F.col("model_stdv")
        rows = rows.withColumn("level", (F.col("level") - F.col("shift")) / F.col("scale"))
    else:
        mean, stdv = F.col("scale") * F.col("model_mean") + F.col("shift"), F.col("model_stdv") * F.col("var")
    return rows.withColumns({"model_mean": F.when(blank, 0.0).otherwise(mean), "model_stdv": F.when(blank, 0.0).otherwise(stdv)})


def event_lines(rows: DataFrame, signals: DataFrame, scalings: DataFrame, model: DataFrame, order: str = "i", collapse: bool = False, scale_events: bool = False, signal_index: bool = False, samples: bool = False) -> DataFrame:
    """read_id, island and line: the table of event alignments, from pairs, signals and model to text.

    rows: read_id, order, contig, ref_pos, ref_kmer, read_name, event_index, model_kmer, hmm_state, and the event's start, length, mean and stdv; signals: read_id, samples, sample_rate; scalings: read_id, shift, scale, var; model: model_kmer, model_mean, model_stdv, one row a k-mer, so it is broadcast. Reads without a signal have no lines. Lines stand in order by read and island."""
    first = ("contig", "ref_kmer", "read_name", "event_index", "model_kmer", "hmm_state")
    d = collapse_raw(rows, signals, order, first, cut=True, join=collapse).join(scalings, "read_id").join(F.broadcast(model), "model_kmer", "left")
    d = scaled_to_model(d.withColumnRenamed("mean", "level"), scale_events)
    if samples:
        text = F.array_join(F.transform("part", lambda x: general((x - F.col("shift")) / F.col("scale"))), ",")
        d = d.withColumn("samples", text)
    d = d.withColumnsRenamed({"ref_pos": "position", "ref_kmer": "reference_kmer"})
    return event_rows(d, signal_index, samples, ("read_id", "island"))


def event_rows(rows: DataFrame, signal_index: bool = False, samples: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event alignments as lines of the table: contig, position, reference_kmer, read_name, event_index, level, stdv, duration (seconds), model_kmer, model_mean, model_stdv, var; start_idx and end_idx, and samples (a text), if asked for. keep: columns that stay beside the line."""
    z = standardised_level(F.col("level"), F.col("model_mean"), F.col("model_stdv"), F.col("var"))
    more = (INDEXED if signal_index else []) + (["samples"] if samples else [])
    digits = {"level": 2, "stdv": 3, "duration": 5, "model_mean": 2, "model_stdv": 2, "z": 2}
    texts = ["contig", "position", "reference_kmer", "read_name", "event_index", "model_kmer", *more]
    # numbers first, as printing names each many times
    d = rows.withColumn("z", z).select(*keep, *[c for c in texts if c not in keep], *[F.col(c).cast("double").alias(f"_{c}") for c in digits])
    number = {c: printed(F.col(f"_{c}"), n) for c, n in digits.items()}
    cells = ["contig", "position", "reference_kmer", "read_name", F.lit("t"), "event_index", *[number[c] for c in ("level", "stdv", "duration")], "model_kmer", *[number[c] for c in ("model_mean", "model_stdv", "z")], *more]
    return d.select(*keep, _line(*cells).alias("line"))


def m6anet_rows(positions: DataFrame, signal_index: bool = False) -> DataFrame:
    """Weighted positions as lines of the table: contig, ref_pos, ref_kmer, read_name, event_level_mean, event_stdv, event_duration. A line ends with a tab, which stands before the indexes if they are asked for."""
    numbers = [printed(F.col(c).cast("double"), n) for c, n in (("event_level_mean", 2), ("event_stdv", 3), ("event_duration", 5))]
    return positions.select(_line("contig", "ref_pos", "ref_kmer", "read_name", *numbers, F.lit(""), *(INDEXED if signal_index else [])).alias("line"))


def summary_rows(moves: DataFrame, rna: bool = False) -> DataFrame:
    """One line a read with events: read_index, read_name, path, counts of moves, total_duration (samples), sample_rate, shift, scale, var."""
    counts = ["num_events", "num_steps", "num_skips", "num_stays"]
    scaling = [printed(F.col(c).cast("double"), 3) for c in ("shift", "scale")] + [F.lit("0.000"), printed(F.col("var").cast("double"), 3)]
    seconds = printed(F.col("total_duration") / F.col("sample_rate"), 2)
    return moves.where("num_events > 0").select(_line("read_index", "read_name", "path", F.lit("rna" if rna else "dna"), F.lit("template"), *counts, seconds, *scaling).alias("line"))


def event_cigars(rows: DataFrame, key: str, order: str = "i") -> DataFrame:
    """The path of a read through events and reference as a CIGAR, and whether events go up or down. rows: key, order, event, ref_pos.

    A next event at the next position is M, at the same position I, further on D and M; events before the first are clipped."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.abs(F.col("ref_pos") - F.lag("ref_pos").over(w))
    op = lambda name, n: F.struct(F.lit(name).alias("op"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
    made = F.array(op("S", F.when(F.col("step").isNull(), F.col("event"))), op("D", F.when(F.col("step") > 1, F.col("step") - 1)), op("M", F.when(F.coalesce(F.col("step") > 0, F.lit(True)), 1)), op("I", F.when(F.col("step") == 0, 1)))
    whole = Window.partitionBy(key)
    stride = F.when(F.min_by("event", order).over(whole) < F.max_by("event", order).over(whole), 1).otherwise(-1)
    ops = rows.select(key, order, "event", step.alias("step"), stride.alias("stride")).select(key, order, "stride", F.posexplode(F.filter(made, lambda o: o["n"] > 0)).alias("part", "o"))
    w = Window.partitionBy(key).orderBy(order, "part")
    fresh = F.when(F.col("o.op") == F.lag("o.op").over(w), 0).otherwise(1)
    runs = ops.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "run").agg(F.first("stride").alias("stride"), F.concat(F.sum("o.n"), F.first("o.op")).alias("piece"))
    return runs.groupBy(key).agg(_joined("run", "piece").alias("cigar"), F.first("stride").alias("stride"))


def signal_paths(rows: DataFrame, key: str, order: str = "i", rna: bool = False) -> DataFrame:
    """The path of a read's signal along the reference: where it starts and ends on both, matched k-mers, and the steps as a string.

    rows: key, order, ref_pos, start and stop (samples of the event, stop not included), reverse (the read lies on the reverse strand). The path follows the signal, so rows are read backwards where events run against the reference. n, is a match of n samples, nI are samples between, nD k-mers passed over."""
    back = F.col("reverse") != F.lit(rna)
    d = rows.select(key, "ref_pos", "start", "stop", back.alias("back"), F.when(F.col("reverse"), F.lit(not rna)).otherwise(F.lit(rna)).alias("turned"), F.col(order).alias("at"))
    d = d.withColumn("at", F.when(F.col("turned"), -F.col("at")).otherwise(F.col("at")))
    w = Window.partitionBy(key).orderBy("at")
    d = d.withColumn("fresh", F.when(F.col("ref_pos") == F.lag("ref_pos").over(w), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = d.groupBy(key, "island").agg(F.first("ref_pos").alias("ref_pos"), F.first("back").alias("back"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    w = Window.partitionBy(key).orderBy("island")
    move = F.when(F.col("back"), -1).otherwise(1)
    passed = F.abs(F.col("ref_pos") - F.lag("ref_pos").over(w) - move)
    return _paths(steps, key, "island", passed, w).select(key, "start_raw", "end_raw", *_ends(rna), "matches", "ss")


def _paths(steps: DataFrame, key: str, order: str, passed: Column, w) -> DataFrame:
    """Pieces for k-mers passed over, samples between and samples matched, joined."""
    pieces = steps.withColumns({"passed": F.coalesce(passed, F.lit(0)), "between": F.coalesce(F.col("start") - F.lag("stop").over(w), F.lit(0)), "samples": F.col("stop") - F.col("start")})
    some = lambda c, mark: F.when(F.col(c) != 0, F.concat(c, F.lit(mark))).otherwise("")
    pieces = pieces.withColumn("piece", F.concat(some("passed", "D"), some("between", "I"), some("samples", ",")))
    return pieces.groupBy(key).agg(
        F.min_by("start", order).alias("start_raw"), F.max_by("stop", order).alias("end_raw"), F.min_by("ref_pos", order).alias("first_pos"), F.max_by("ref_pos", order).alias("last_pos"),
        F.first("back").alias("back"), F.count_if(F.col("samples") != 0).alias("matches"), _joined(order, "piece").alias("ss"),
    )


def _ends(rna: bool) -> list[Column]:
    low = F.when(F.col("back"), F.col("last_pos")).otherwise(F.col("first_pos"))
    high = F.when(F.col("back"), F.col("first_pos")).otherwise(F.col("last_pos")) + 1
    return [(high if rna else low).alias("start_kmer"), (low if rna else high).alias("end_kmer")]


def paf_rows(paths: DataFrame, k: int) -> DataFrame:
    """signal_paths as PAF lines. paths also with read_name, len_raw, reverse, contig, contig_length, scale, shift."""
    strand = F.when(F.col("reverse"), "-").otherwise("+")
    block = F.abs(F.col("end_kmer") - F.col("start_kmer"))
    tags = [F.concat(F.lit(f"{name}:f:"), printed(F.col(c).cast("double"), 2)) for name, c in (("sc", "scale"), ("sh", "shift"))]
    return paths.select(_line("read_name", "len_raw", "start_raw", "end_raw", strand, "contig", F.col("contig_length") - (k - 1), "start_kmer", "end_kmer", "matches", block, F.lit(NO_MAPQ), *tags, F.concat(F.lit("ss:Z:"), "ss")).alias("line"))


def sam_rows(records: DataFrame) -> DataFrame:
    """SAM records with the signal's path as tags. records: line (of the alignment), and the columns of signal_paths with scale and shift, null where a read has no path, whose line goes."""
    tags = [F.concat(F.lit("si:Z:"), F.concat_ws(",", "start_raw", "end_raw", "start_kmer", "end_kmer")), F.concat(F.lit("ss:Z:"), "ss")]
    tags += [F.concat(F.lit(f"{name}:f:"), F.regexp_replace(F.col(c).cast("float").cast("string"), r"\.0$", "")) for name, c in (("sc", "scale"), ("sh", "shift"))]
    return records.where("ss is not null").select(_line("line", *tags).alias("line"))


def event_sam_rows(cigars: DataFrame) -> DataFrame:
    """event_cigars as SAM records in event space. cigars also with read_name, reverse, contig, pos (from 0), mapq."""
    name, flag = F.concat("read_name", F.lit(".template")), F.when(F.col("reverse"), 16).otherwise(0)
    star = F.lit("*")
    return cigars.select(_line(name, flag, "contig", F.col("pos") + 1, "mapq", "cigar", star, F.lit(0), F.lit(0), star, star, F.concat(F.lit("ES:i:"), "stride")).alias("line"))


def resquiggle_kmers(mapped: DataFrame, sizes: DataFrame, key: str, rna: bool = False) -> DataFrame:
    """Every k-mer of a read in signal order with the samples it is mapped to, null for none. mapped: key, kmer, start, stop; sizes: key, n_kmers. RNA is read from its end."""
    kmers = sizes.where("n_kmers > 0").select(key, "n_kmers", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_kmers").cast("bigint") - 1)).alias("kmer"))
    at = F.col("n_kmers") - 1 - F.col("kmer") if rna else F.col("kmer")
    return kmers.withColumn("at", at).join(mapped.select(key, F.col("kmer").cast("bigint").alias("kmer"), "start", "stop"), [key, "kmer"], "left")


def resquiggle_rows(kmers: DataFrame, key: str) -> DataFrame:
    """resquiggle_kmers as lines; a dot where nothing is mapped."""
    return kmers.select(_line(F.col(key).cast("string"), "kmer", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("start", "stop"))).alias("line"))


def resquiggle_paths(kmers: DataFrame, key: str, rna: bool = False) -> DataFrame:
    """The path of a read's signal along its own k-mers, as in signal_paths; k-mers without samples count once one with samples came before and another comes after. Reads with none have no row."""
    steps = kmers.where("start is not null").select(key, F.col("at").alias("ref_pos"), F.lit(False).alias("back"), "start", "stop")
    w = Window.partitionBy(key).orderBy("ref_pos")
    passed = F.col("ref_pos") - F.lag("ref_pos").over(w) - 1
    found = _paths(steps, key, "ref_pos", passed, w)
    if rna:
        found = found.join(kmers.groupBy(key).agg(F.max("n_kmers").alias("n_kmers")), key)
    first, last = ("n_kmers - first_pos", "n_kmers - 1 - last_pos") if rna else ("first_pos", "last_pos + 1")
    return found.select(key, "start_raw", "end_raw", F.expr(first).alias("start_kmer"), F.expr(last).alias("end_kmer"), "matches", "ss")


def resquiggle_paf_rows(paths: DataFrame, key: str) -> DataFrame:
    """resquiggle_paths as PAF lines, the read's own k-mers as target and as block. paths also with len_raw, n_kmers, and the read's own scale and shift, six digits each."""
    tags = [F.concat(F.lit(f"{name}:f:"), printed(F.col(c).cast("double"), 6)) for name, c in (("sc", "scale"), ("sh", "shift"))]
    name = F.col(key).cast("string")
    return paths.select(_line(name, "len_raw", "start_raw", "end_raw", F.lit("+"), name, "n_kmers", "start_kmer", "end_kmer", "matches", "n_kmers", F.lit(NO_MAPQ), *tags, F.concat(F.lit("ss:Z:"), "ss")).alias("line"))
