"""Alignments or events joined to their reads' signals.

Signals are wide. Before they are shuffled, a filter of fixed size, made of the
read ids asked for, rules out those that no row wants; it is a table of words
of bits that is broadcast, so the test is two hash lookups on the signals' own
tasks. It lets through all that match and few others, and never decides a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.operators.events import _islands

#: Bits of the filter; 2 ** 19 words of 64 bits at most, 8 MB broadcast, whatever the number of ids.
FILTER_BITS = 25
SEEDS = (1, 2)


def _bit(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """word, bits: the filter's words that are not zero, of at most 2 ** (FILTER_BITS - 6) rows."""
    bits = ids.select(F.explode(F.array(*[_bit(key, s) for s in SEEDS])).alias("b"))
    return bits.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))


def prunable(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of wide whose key may be among ids."""
    words = id_filter(ids, key)
    out = wide
    for s in SEEDS:
        w = F.broadcast(words.select(F.col("word").alias(f"_w{s}"), F.col("bits").alias(f"_b{s}")))
        out = out.join(w, F.shiftright(_bit(key, s), 6) == F.col(f"_w{s}"))
        out = out.where(F.shiftrightunsigned(F.col(f"_b{s}"), 0).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, {s}), 64) as int))")) != 0)
    return out.select(*wide.columns)


def with_signals(rows: DataFrame, signals: DataFrame, on_missing: str = "skip") -> DataFrame:
    """rows with samples, the signal of their read (read_id), of one sample at least. A read without one is skipped or ends the job (abort). signals: read_id (unique), samples, and whatever else a signal has, which comes along."""
    if on_missing not in ("skip", "abort"):
        raise ValueError(f"on_missing is skip or abort, not {on_missing}")
    found = prunable(signals.where(F.size("samples") > 0), rows.select("read_id"), "read_id")
    if on_missing == "skip":
        return rows.join(found, "read_id")
    out = rows.join(found, "read_id", "left")
    missing = F.raise_error(F.concat(F.lit("no signal for read "), F.coalesce(F.col("read_id").cast("string"), F.lit("null"))))
    return out.withColumn("samples", F.when(F.col("samples").isNull(), missing).otherwise(F.col("samples")))


FIRST = ("event_index", "model_kmer")


def collapse_raw(rows: DataFrame, signals: DataFrame, order: str = "i", first: tuple[str, ...] = FIRST, cut: bool = False, join: bool = True) -> DataFrame:
    """Runs of consecutive rows at one position as one row, measured anew on the signal.

    rows: read_id, order, ref_pos, the columns named in first, start and length (samples of the event), mean and stdv; signals: read_id, samples, sample_rate. A run of one row keeps its event's mean and deviation. One of several gets those of all samples from where its first or last event starts, whichever is earlier, to where the first or last ends; the columns of first are those of its first row. cut: also part, the samples of the run. join: rows of one position become one; else every row stays, measured as it was. The runs of a read lie in one row beside its signal, so the signal is joined once; runs hardly overlap, so the sums are linear in its length."""
    r = rows.withColumn("stop", F.col("start") + F.col("length"))
    r = _islands(r, "read_id", order) if join else r.withColumn("island", F.col(order))
    head, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    runs = r.groupBy("read_id", "island", "ref_pos").agg(
        *[head(c).alias(c) for c in first], F.count("*").alias("n"), head("mean").alias("mean"), head("stdv").alias("stdv"),
        F.least(head("start"), last("start")).alias("start_idx"), F.greatest(head("stop"), last("stop")).alias("end_idx"),
    )
    held = runs.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("island", "ref_pos", *first, "n", "mean", "stdv", "start_idx", "end_idx"))).alias("runs"))
    joined = with_signals(held, signals)
    span = lambda x: F.slice("samples", (x["start_idx"] + 1).cast("int"), (x["end_idx"] - x["start_idx"]).cast("int"))

    def measured(x):
        part = span(x)
        # mean in a first pass, deviation in a second, as differences of sums of squares lose digits
        mean = F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part)
        moments = F.get(F.transform(F.array(mean), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(part)).alias("stdv"))), F.lit(0))
        own = F.struct(x["mean"].cast("double").alias("mean"), x["stdv"].cast("double").alias("stdv"))
        return F.struct(x.alias("x"), F.when((x["n"] > 1) & (x["end_idx"] > x["start_idx"]), moments).otherwise(own).alias("m"), *([part.alias("part")] if cut else []))

    out = joined.select("read_id", "sample_rate", F.explode(F.transform("runs", measured)).alias("r"))
    x = F.col("r.x")
    return out.select(
        "read_id", *[x[c].alias(c) for c in ("ref_pos", *first, "start_idx", "end_idx")], F.col("r.m.mean").alias("mean"), F.col("r.m.stdv").alias("stdv"),
        ((x["end_idx"] - x["start_idx"]) / F.col("sample_rate")).alias("duration"), *([x["island"].alias("island"), F.col("r.part").alias("part")] if cut else []),
    )
