"""Order-dependent operators over sites and events: grouping, as-of, windows, scaling, collapsing.

Every window is partitioned by read or contig tile, so memory is that of one
read; array forms avoid the shuffle where the rows of a read already stand in
one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.functions.signal import cpg_positions

GAP, FLANK, SPAN = 10, 10, 200


def cpg_groups(sequences: DataFrame, key: str) -> DataFrame:
    """CpGs less than GAP + 1 apart as one group; groups too near the start or too wide go. sequences: key, seq."""
    sites = sequences.select(key, F.explode(cpg_positions(F.col("seq"))).alias("pos"))
    w = Window.partitionBy(key).orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) <= GAP, 0).otherwise(1)
    groups = sites.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = groups.groupBy(key, "grp").agg(F.min("pos").alias("first_cpg"), F.max("pos").alias("last_cpg"), F.count("*").alias("n_cpg"))
    return out.where((F.col("first_cpg") - FLANK > FLANK) & (F.col("last_cpg") - F.col("first_cpg") <= SPAN)).drop("grp")


def nearest_event(rows: DataFrame, key: str, reach: int = 1000) -> DataFrame:
    """As-of: each k-mer's own event or the nearest before within reach, else the nearest after. rows: key, kmer, event (null if none). K-mer 0 is not found backwards and the last not forwards."""
    w = Window.partitionBy(key).orderBy("kmer")
    d = rows.withColumn("last", F.max("kmer").over(Window.partitionBy(key)))
    back = F.last(F.when(F.col("kmer") > 0, F.col("event")), True).over(w.rowsBetween(-reach, 0))
    ahead = F.first(F.when(F.col("kmer") < F.col("last"), F.col("event")), True).over(w.rowsBetween(0, reach))
    return d.select(key, "kmer", F.coalesce(F.when(F.col("kmer") > 0, back), ahead, F.lit(-1)).alias("event"))


def prefix_sums(samples: DataFrame, key: str) -> DataFrame:
    """Exclusive prefix sums of x and its square. samples: key, i, x."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return samples.select(key, "i", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("x") * F.col("x")).over(w), F.lit(0)).alias("q"))


def t_statistic(samples: DataFrame, key: str, width: int) -> DataFrame:
    """Difference of the means of the windows before and from i, in units of its error; 0 within width of either end."""
    w = Window.partitionBy(key).orderBy("i")
    before, after, all_ = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1), Window.partitionBy(key)
    x, sq = F.col("x").cast("double"), F.col("x").cast("double") * F.col("x")
    s = samples.select(key, "i", F.sum(x).over(before).alias("s1"), F.sum(x).over(after).alias("s2"), F.sum(sq).over(before).alias("q1"), F.sum(sq).over(after).alias("q2"), F.count("*").over(all_).alias("n"))
    m1, m2 = F.col("s1") / width, F.col("s2") / width
    var = F.greatest(F.col("q1") / width - m1 * m1 + F.col("q2") / width - m2 * m2, F.lit(1.17549435e-38))
    return s.select(key, "i", F.when((F.col("i") >= width) & (F.col("i") <= F.col("n") - width) & (F.col("n") >= 2 * width), F.abs(m2 - m1) / F.sqrt(var / width)).otherwise(0.0).alias("t"))


def moment_scaling(events: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """shift and scale by the method of moments. events: key, mean; model: key, level_mean of each of the read's k-mers. Both sides are sums, so a long read costs one row per task."""
    square = lambda c: F.avg(F.col(c).cast("double") * F.col(c))
    e = events.groupBy(key).agg(F.avg("mean").alias("e_mean"), square("mean").alias("e_sq"))
    m = model.groupBy(key).agg(F.avg("level_mean").alias("k_mean"), square("level_mean").alias("k_sq"))
    j = e.join(m, key).withColumn("shift", F.col("e_mean") - F.col("k_mean"))
    sq = F.col("e_sq") - 2 * F.col("shift") * F.col("e_mean") + F.col("shift") * F.col("shift")
    return j.select(key, "shift", (sq / F.col("k_sq")).alias("scale"))


def recalibration(rows: DataFrame, key: str, least: int = 200) -> DataFrame:
    """Weighted least squares of event mean on level mean with weights 1 / sd ** 2. rows: key, mean, level_mean, level_stdv of match rows. var from the residual moments, so one pass is enough."""
    w, x, y = 1 / (F.col("level_stdv") * F.col("level_stdv")), F.col("level_mean"), F.col("mean")
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(w).alias("a00"), F.sum(w * x).alias("a01"), F.sum(w * x * x).alias("a11"), F.sum(w * y).alias("b0"), F.sum(w * x * y).alias("b1"), F.sum(w * y * y).alias("c"))
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
    s = s.where(det != 0).withColumn("shift", (F.col("a11") * F.col("b0") - F.col("a01") * F.col("b1")) / det).withColumn("scale", (F.col("a00") * F.col("b1") - F.col("a01") * F.col("b0")) / det)
    rest = F.col("c") - F.col("shift") * F.col("b0") - F.col("scale") * F.col("b1")
    return s.select(key, "n", "shift", "scale", F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("var"), (F.col("n") >= least).alias("enough"))


def match_states(rows: DataFrame, key: str, order: str = "i") -> DataFrame:
    """M where the k-mer rank changes, else E."""
    same = F.col("kmer_rank") == F.lag("kmer_rank").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("state", F.when(F.coalesce(same, F.lit(False)), "E").otherwise("M"))


def move_summary(rows: DataFrame, key: str, order: str = "i") -> DataFrame:
    """Steps, stays and skips between consecutive event alignments. The first row of a read has no predecessor and counts as none of them; a move back is a skip."""
    move = F.col("ref_pos") - F.lag("ref_pos").over(Window.partitionBy(key).orderBy(order))
    m = rows.select(key, move.alias("move"), "duration")
    return m.groupBy(key).agg(
        F.count("*").alias("num_events"),
        F.count_if(F.col("move") == 1).alias("num_steps"),
        F.count_if((F.col("move") > 1) | (F.col("move") < 0)).alias("num_skips"),
        F.count_if(F.col("move") == 0).alias("num_stays"),
        F.sum("duration").alias("total_duration"),
    )


def _islands(rows: DataFrame, key: str, order: str) -> DataFrame:
    """island: the number of the run of consecutive rows at one position."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.col("ref_pos") == F.lag("ref_pos").over(w), 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def collapse(rows: DataFrame, key: str, order: str = "i") -> DataFrame:
    """Runs of consecutive rows at one position as one row: length-weighted mean, total length, first event and k-mer. What a signal says of a run is measured by signals.collapse_raw."""
    r = _islands(rows, key, order)
    total = F.sum("length")
    return r.groupBy(key, "island", "ref_pos").agg(
        F.min_by("event_index", order).alias("event_index"), F.min_by("model_kmer", order).alias("model_kmer"), total.alias("length"), F.when(total != 0, F.sum(F.col("level") * F.col("length")) / total).otherwise(float("nan")).alias("level")
    )


def weighted_positions(rows: DataFrame, key: str, order: str = "i", scaled: bool = False, indexed: bool = False) -> DataFrame:
    """Runs of consecutive rows at one position as one row: length-weighted level, deviation and duration of the rows whose k-mers agree, NaN where none does.

    scaled: levels are brought to the model first, by the read's shift and scale. indexed: also start_idx and end_idx, the samples from where the run's first or last event (start to stop) starts to where the first or last ends, whatever their k-mers."""
    if scaled:
        rows = rows.withColumn("level", (F.col("level") - F.col("shift")) / F.col("scale"))
    length = F.when(F.col("ref_kmer") == F.col("model_kmer"), F.col("length")).otherwise(0)
    total = F.sum(length)
    mean = lambda c: F.when(total != 0, F.sum(F.col(c) * length) / total).otherwise(float("nan"))
    ends = lambda f, c: f(F.min_by(c, order), F.max_by(c, order))
    return _islands(rows, key, order).groupBy(key, "island", "ref_pos").agg(
        F.min_by("ref_kmer", order).alias("ref_kmer"),
        mean("level").alias("event_level_mean"),
        mean("stdv").alias("event_stdv"),
        mean("duration").alias("event_duration"),
        total.alias("event_length"),
        *([ends(F.least, "start").alias("start_idx"), ends(F.greatest, "stop").alias("end_idx")] if indexed else []),
    )


def base_to_event(pairs: DataFrame, key: str) -> DataFrame:
    """First and last new event per k-mer: an event counts at the first k-mer it is aligned to. pairs: key, i, kmer, event."""
    new = F.coalesce(F.col("event") != F.lag("event").over(Window.partitionBy(key).orderBy("i")), F.lit(True))
    return pairs.withColumn("new", new).where("new").groupBy(key, "kmer").agg(F.min("event").alias("start"), F.max("event").alias("stop"))


def events_per_base(pairs: DataFrame, n_kmers: DataFrame, key: str) -> DataFrame:
    span = pairs.groupBy(key).agg((F.max("event") - F.min("event")).alias("span"))
    return span.join(n_kmers, key).select(key, (F.col("span") / F.col("n_kmers")).alias("events_per_base"))


def cigar_pairs(cigars: DataFrame, key: str) -> DataFrame:
    """Aligned (ref_pos, read_pos) pairs. cigars: key, pos, ops array<struct<op, len>>. M, = and X align; D moves the reference, I and S the read, N starts a new segment."""
    with_offsets = F.expr(
        "aggregate(ops, struct(0 as ref, 0 as read, 0 as seg, cast(array() as array<struct<ref:int,read:int,seg:int,len:int>>) as got),"
        " (a, o) -> struct(a.ref + CASE WHEN o.op in ('M','=','X','D','N') THEN o.len ELSE 0 END as ref, a.read + CASE WHEN o.op in ('M','=','X','I','S') THEN o.len ELSE 0 END as read,"
        " a.seg + CASE WHEN o.op = 'N' THEN 1 ELSE 0 END as seg, CASE WHEN o.op in ('M','=','X') THEN concat(a.got, array(struct(a.ref as ref, a.read as read, a.seg as seg, o.len as len))) ELSE a.got END as got), a -> a.got)"
    )
    blocks = cigars.select(key, "pos", F.explode(with_offsets).alias("b"))
    return blocks.select(key, F.col("b.seg").alias("segment"), "pos", "b", F.explode(F.expr("CASE WHEN b.len > 0 THEN sequence(0, b.len - 1) ELSE array() END")).alias("k")).select(key, "segment", (F.col("pos") + F.col("b.ref") + F.col("k")).alias("ref_pos"), (F.col("b.read") + F.col("k")).alias("read_pos"))
