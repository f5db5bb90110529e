"""All queries of the signal engine by name, and the SQL that DuckDB answers the same with.

Keys follow the survey's operator catalogue. Each query runs over a whole view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.functions import signal as S
from siglake.operators import events as E
from siglake.operators import frequency as Q
from siglake.operators import reads as R
from siglake.plans.views import view
from siglake.plans.views import view_sql as V

QUERIES, ORACLES = {}, {}
CALLS, READS, ALN, REGIONS, PAIRS, SAMPLES, SUMMARY = (V(n) for n in ("methcalls", "reads", "alignments", "regions", "aligned", "samples", "summary"))


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# --- frequency -------------------------------------------------------------

FREQ = """SELECT chromosome, start, "end", arg_min(num_motifs, row_no) AS num_motifs_in_group, CAST(sum(num_motifs) AS BIGINT) AS called_sites, CAST(sum(CASE WHEN log_lik_ratio > 0 THEN num_motifs ELSE 0 END) AS BIGINT) AS called_sites_methylated,
 CAST(sum(CASE WHEN log_lik_ratio > 0 THEN num_motifs ELSE 0 END) AS DOUBLE) / CAST(sum(num_motifs) AS DOUBLE) AS methylated_frequency, arg_min(sequence, row_no) AS group_sequence
 FROM {calls} WHERE abs(log_lik_ratio) >= 2.5 GROUP BY chromosome, start, "end" """
SPLIT = f"""(SELECT chromosome, CASE WHEN num_motifs > 1 THEN start + k ELSE start END AS start, CASE WHEN num_motifs > 1 THEN start + k ELSE "end" END AS "end", log_lik_ratio, CASE WHEN num_motifs > 1 THEN 1 ELSE num_motifs END AS num_motifs, CASE WHEN num_motifs > 1 THEN 'split-group' ELSE sequence END AS sequence, row_no
 FROM (SELECT *, unnest(CASE WHEN num_motifs > 1 THEN list_transform(list_filter(range(len(sequence) - 1), lambda i: substr(sequence, i + 1, 2) = 'CG'), lambda p: p - (instr(sequence, 'CG') - 1)) ELSE [0] END) AS k FROM {CALLS}))"""
_file = lambda k: "(" + FREQ.format(calls=f"(SELECT * FROM {CALLS} WHERE start % 3 = {k} OR row_no % 4 = {k})") + ")"


@query(FREQ.format(calls=CALLS))
def meth_freq(spark, sf):
    return Q.ordered(Q.site_frequency(view(spark, sf, "methcalls")))


@query(FREQ.format(calls=SPLIT))
def meth_freq_split(spark, sf):
    return Q.ordered(Q.site_frequency(view(spark, sf, "methcalls"), split=True))


def _files(spark, sf):
    calls = view(spark, sf, "methcalls")
    return [Q.site_frequency(calls.where(f"start % 3 = {k} or row_no % 4 = {k}")) for k in range(3)]


_merged = " UNION ALL ".join(f"SELECT *, {k} AS file, row_number() OVER (PARTITION BY chromosome, start ORDER BY \"end\", group_sequence) AS nth FROM {_file(k)}" for k in range(3))


@query(
    f"""SELECT chromosome, start, arg_max("end", file) AS "end", arg_max(num_motifs_in_group, file) AS num_motifs_in_group, CAST(sum(called_sites) AS BIGINT) AS called_sites, CAST(sum(called_sites_methylated) AS BIGINT) AS called_sites_methylated,
 CASE WHEN count(*) = 1 THEN min(methylated_frequency) ELSE CAST(sum(called_sites_methylated) AS DOUBLE) / CAST(sum(called_sites) AS DOUBLE) END AS methylated_frequency, arg_min(seq_, file) AS group_sequence
 FROM (SELECT *, concat(chromosome, ':', start) AS seq_ FROM ({_merged})) GROUP BY chromosome, start, nth"""
)
def freq_merge(spark, sf):
    files = [f.withColumn("group_sequence", F.concat_ws(":", "chromosome", "start")) for f in _files(spark, sf)]  # sites of the view differ in their sequences
    return Q.ordered(Q.merge_frequencies(files))


ORACLES["freq_merge"] = ORACLES["freq_merge"].replace('ORDER BY "end", group_sequence', 'ORDER BY "end"')
_pick = lambda k: f"(SELECT * FROM {_file(k)} WHERE num_motifs_in_group = 1 AND called_sites > 0)"
COMPARED = f"""SELECT a.chromosome, a.start, a."end", a.called_sites AS depth_1, a.methylated_frequency AS frequency_1, b.called_sites AS depth_2, b.methylated_frequency AS frequency_2
 FROM {_pick(0)} a JOIN {_pick(1)} b ON a.chromosome = b.chromosome AND a.start = b.start AND a."end" = b."end" """


def _compared(spark, sf):
    files = _files(spark, sf)
    return Q.compare_frequencies(files[0], files[1])


@query(COMPARED)
def freq_compare(spark, sf):
    return _compared(spark, sf)


@query(f"SELECT count(*) AS n, round(corr(frequency_1, frequency_2), 6) AS r FROM ({COMPARED})")
def freq_corr(spark, sf):
    return Q.correlation(_compared(spark, sf)).select("n", F.round("r", 6).alias("r"))


@query(f"SELECT CAST(least(floor(frequency_1 * 25), 24) AS INT) AS bin_1, CAST(least(floor(frequency_2 * 25), 24) AS INT) AS bin_2, count(*) AS n FROM ({COMPARED}) GROUP BY ALL")
def freq_hist2d(spark, sf):
    return Q.histogram_2d(_compared(spark, sf))


@query(
    f"""SELECT chromosome, start - back AS start, start - back AS "end", CAST(sum(coverage) AS BIGINT) AS depth, CAST(sum(CAST(trunc((percent / 100) * coverage) AS BIGINT)) AS BIGINT) AS methylated
 FROM (SELECT chromosome, start, CASE WHEN strand = '-' THEN 1 ELSE 0 END AS back, num_motifs * 7 AS coverage, CAST(row_no % 101 AS DOUBLE) AS percent FROM {CALLS}) GROUP BY ALL"""
)
def bedmethyl_accumulate(spark, sf):
    rows = view(spark, sf, "methcalls").selectExpr("chromosome", "start", "strand", "num_motifs * 7 as coverage", "cast(row_no % 101 as double) as percent")
    return Q.accumulate_bedmethyl(rows)


@query(f"""SELECT read_name, start, "end", log_lik_ratio FROM {CALLS} WHERE chromosome = 'click' AND start >= 50 AND "end" < 400""")
def clip_window(spark, sf):
    return Q.clip_window(view(spark, sf, "methcalls"), "click", 50, 400).select("read_name", "start", "end", "log_lik_ratio")


# --- alignments and reads --------------------------------------------------


@query(f"SELECT count(*) AS total, count_if(mapq < 20) AS skip_mapq, count_if(mapq >= 20 AND (flag & 4) <> 0) AS unmapped, count_if(mapq >= 20 AND (flag & 4) = 0 AND (flag & 256) <> 0) AS secondary, count_if(mapq >= 20 AND (flag & 4) = 0 AND (flag & 256) = 0) AS kept FROM {ALN}")
def aln_filter_counts(spark, sf):
    return R.filter_counts(view(spark, sf, "alignments"))


@query(f"SELECT * FROM {ALN} WHERE mapq >= 20 AND (flag & 4) = 0 AND (flag & 256) = 0")
def aln_primary(spark, sf):
    return R.primary(view(spark, sf, "alignments"))


@query(f"SELECT read_id, length(seq) > 2000 AS long, length(seq) AS n FROM {READS}")
def ultra_split(spark, sf):
    short, long = R.split_long(view(spark, sf, "reads"), 2000)
    return short.select("read_id", F.lit(False).alias("long"), F.length("seq").cast("bigint").alias("n")).union(long.select("read_id", F.lit(True), F.length("seq").cast("bigint")))


@query(f"SELECT a.read_id, a.contig, a.pos, coalesce(length(seq), 0) AS n FROM {ALN} a LEFT JOIN {READS} r ON a.read_id = r.read_id")
def aln_reads_join(spark, sf):
    lengths = F.length("seq").cast("bigint")
    return R.with_reads(view(spark, sf, "alignments").select("read_id", "contig", "pos"), view(spark, sf, "reads"), lengths, "n", 0)


@query(f"SELECT DISTINCT a.read_id FROM {ALN} a ANTI JOIN {READS} r ON a.read_id = r.read_id")
def aln_missing_reads(spark, sf):
    return R.missing_reads(view(spark, sf, "alignments"), view(spark, sf, "reads")).select("read_id")


@query(f"SELECT f.read_id, f.pos AS first_pos, l.pos AS last_pos FROM (SELECT read_id, arg_min(pos, ord) AS pos FROM {ALN} GROUP BY read_id) f JOIN (SELECT read_id, arg_max(pos, ord) AS pos FROM {ALN} GROUP BY read_id) l USING (read_id)")
def readdb_dedupe(spark, sf):
    a = view(spark, sf, "alignments")
    first = R.first_reads(a).select("read_id", F.col("pos").alias("first_pos"))
    return first.join(R.last_paths(a.withColumnRenamed("pos", "path")).withColumnRenamed("path", "last_pos"), "read_id")


@query(f"SELECT read_id, ord, pos FROM {ALN} WHERE contig = 'N' AND pos < 9000 AND ref_end > 5000")
def region_scan(spark, sf):
    return R.in_region(view(spark, sf, "alignments"), "N", 5000, 9000).select("read_id", "ord", "pos")


@query(f"SELECT a.read_id, a.ord, a.pos, r.r_start FROM {ALN} a JOIN {REGIONS} r ON a.contig = r.contig AND a.pos < r.r_end AND a.ref_end > r.r_start")
def bed_regions(spark, sf):
    return R.in_regions(view(spark, sf, "alignments"), view(spark, sf, "regions")).select("read_id", "ord", "pos", "r_start")


@query(f"WITH per AS (SELECT filename, count(*) AS n FROM {SUMMARY} GROUP BY filename), m AS (SELECT n AS mode, count(*) AS files FROM per GROUP BY n ORDER BY files DESC, n LIMIT 1) SELECT filename, n FROM per, m WHERE n > CASE WHEN files > 20 THEN mode ELSE 4000 END")
def fast5_mode_filter(spark, sf):
    return R.crowded_files(view(spark, sf, "summary"))


@query(f"SELECT CAST(floor(length(seq) / 1000) AS BIGINT) AS bin, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM (SELECT DISTINCT read_id, seq FROM {READS}) GROUP BY bin")
def readlen_hist(spark, sf):
    return R.length_histogram(view(spark, sf, "reads"))


STATS = "SELECT l_orderkey AS read_id, CAST(l_quantity AS BIGINT) * 40 AS n_events, l_linenumber * 20 AS n_bases, -l_tax * 80 AS avg_emission, l_suppkey % 60 AS max_gap, l_partkey % 9 > 0 AS spans, l_partkey % 1000 AS n_match, l_discount * 30 AS var, l_linenumber * 0.9 AS events_per_base FROM {t}"


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN bad THEN 2 WHEN n_match < 200 OR var > 2.5 THEN 1 WHEN events_per_base > 5.0 THEN 4 ELSE 0 END AS status FROM (SELECT *, (n_events / n_bases >= 15 OR avg_emission < -5 OR max_gap > 50 OR NOT spans) AS bad FROM ({STATS.format(t='lineitem')}))) GROUP BY status")
def status_gate(spark, sf):
    stats = spark.sql(STATS.format(t="{t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return R.read_status(stats).groupBy("status").agg(F.count("*").alias("n"))


# --- sequences -------------------------------------------------------------


@query(f"SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM {READS}")
def revcomp(spark, sf):
    return view(spark, sf, "reads").select("read_id", S.reverse_complement(F.col("seq")).alias("seq"))


@query("SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'MRWSYKVHDBN', 'AAACCGAAACA') AS seq FROM documents")
def disambiguate(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", S.disambiguate(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


@query(f"SELECT read_id, replace(seq, 'CG', 'MG') AS forward, replace(reverse(translate(seq, 'ACGT', 'TGCA')), 'CG', 'MG') AS backward FROM {READS}")
def methylate(spark, sf):
    m = S.methylate(F.col("seq"))
    return view(spark, sf, "reads").select("read_id", m.alias("forward"), S.reverse_complement_methylated(m).alias("backward"))


@query(f"SELECT kmer, count(*) AS n, min(kmer_rank) AS kmer_rank FROM (SELECT kmer, list_sum(list_transform(range(6), lambda i: (instr('ACGT', substr(kmer, i + 1, 1)) - 1) * CAST(pow(4, 5 - i) AS BIGINT)))::BIGINT AS kmer_rank FROM (SELECT substr(seq, unnest(range(1, length(seq) - 4)), 6) AS kmer FROM {READS})) GROUP BY kmer")
def kmer_rank4(spark, sf):
    k = view(spark, sf, "reads").select(F.explode(S.kmers(F.col("seq"), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return k.withColumn("kmer_rank", S.kmer_rank(F.col("kmer")))


@query(f"SELECT kmer, count(*) AS n, list_sum(list_transform(range(6), lambda i: (instr('ACGMT', substr(kmer, i + 1, 1)) - 1) * CAST(pow(5, 5 - i) AS BIGINT)))::BIGINT AS kmer_rank FROM (SELECT substr(seq, unnest(range(1, length(seq) - 4)), 6) AS kmer FROM (SELECT replace(seq, 'CG', 'MG') AS seq FROM {READS})) GROUP BY kmer")
def kmer_rank5(spark, sf):
    k = view(spark, sf, "reads").select(F.explode(S.kmers(S.methylate(F.col("seq")), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return k.withColumn("kmer_rank", S.kmer_rank(F.col("kmer"), 5))


@query(f"SELECT read_id, CAST(sum(80 + r % 37) AS BIGINT) AS level_sum, count(*) AS n FROM (SELECT read_id, list_sum(list_transform(range(6), lambda i: (instr('ACGT', substr(kmer, i + 1, 1)) - 1) * CAST(pow(4, 5 - i) AS BIGINT)))::BIGINT AS r FROM (SELECT read_id, substr(seq, unnest(range(1, length(seq) - 4)), 6) AS kmer FROM {READS})) GROUP BY read_id")
def kmer_model_join(spark, sf):
    levels = [80 + r % 37 for r in range(4**6)]  # the model: 4 ** k levels by its nature
    found = view(spark, sf, "reads").select("read_id", S.level_sum(levels, 6)("seq").alias("f"))
    return found.select("read_id", "f.level_sum", "f.n").where("n > 0")


_sites = f"(SELECT read_id, unnest(list_filter(range(length(seq) - 1), lambda i: substr(seq, i + 1, 2) = 'CG')) AS pos FROM {READS})"


@query(f"SELECT read_id, pos FROM {_sites}")
def cpg_sites(spark, sf):
    return view(spark, sf, "reads").select("read_id", F.explode(S.cpg_positions(F.col("seq"))).alias("pos"))


@query(f"SELECT read_id, min(pos) AS first_cpg, max(pos) AS last_cpg, count(*) AS n_cpg FROM (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY pos) AS grp FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY read_id ORDER BY pos) <= 10 THEN 0 ELSE 1 END AS fresh FROM {_sites})) GROUP BY read_id, grp HAVING min(pos) > 20 AND max(pos) - min(pos) <= 200")
def cpg_groups(spark, sf):
    return E.cpg_groups(view(spark, sf, "reads"), "read_id")


CIGAR = "SELECT l_orderkey * 10 + l_linenumber AS read_id, l_partkey AS pos, {ops} AS ops FROM {t}"
_lens = "CAST(l_quantity AS INT) % 9 + 1", "l_linenumber % 3", "l_linenumber % 4", "CAST(l_quantity AS INT) % 5"


@query("SELECT read_id, 0 AS segment, pos + k AS ref_pos, l1 + k AS read_pos FROM (SELECT *, unnest(range(m1)) AS k FROM c) UNION ALL SELECT read_id, 0, pos + m1 + d + k, l1 + m1 + i + k FROM (SELECT *, unnest(range(m2)) AS k FROM c)".replace("FROM c)", "FROM (SELECT l_orderkey * 10 + l_linenumber AS read_id, l_partkey AS pos, 2 AS l1, {} AS m1, {} AS d, {} AS i, {} AS m2 FROM lineitem))".format(*_lens)))
def cigar_pairs(spark, sf):
    ops = "array(named_struct('op', 'S', 'len', 2), " + ", ".join(f"named_struct('op', '{o}', 'len', {n})" for o, n in zip("MDIM", _lens)) + ")"
    d = spark.sql(CIGAR.format(ops=ops, t="{t}"), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return E.cigar_pairs(d.withColumn("ops", F.col("ops").cast("array<struct<op:string,len:int>>")), "read_id")


# --- events ----------------------------------------------------------------


@query(
    f"""SELECT read_id, i AS kmer, coalesce(CASE WHEN i > 0 THEN last_value(CASE WHEN i > 0 THEN event END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 1000 PRECEDING AND CURRENT ROW) END,
 first_value(CASE WHEN i < m THEN event END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1000 FOLLOWING), -1) AS event FROM (SELECT *, max(i) OVER (PARTITION BY read_id) AS m FROM {PAIRS})"""
)
def nearest_event(spark, sf):
    return E.nearest_event(view(spark, sf, "aligned").select("read_id", F.col("i").alias("kmer"), "event"), "read_id")


_w = "OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN {} AND {})"


@query(f"SELECT read_id, i, CAST(coalesce(sum(x) {_w.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, 0) AS BIGINT) AS s, CAST(coalesce(sum(x * x) {_w.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, 0) AS BIGINT) AS q FROM {SAMPLES}")
def prefix_sums(spark, sf):
    return E.prefix_sums(view(spark, sf, "samples"), "read_id")


_s = {n: f"CAST(sum({x}) {_w.format(a, b)} AS DOUBLE)" for n, x, a, b in (("s1", "x", "3 PRECEDING", "1 PRECEDING"), ("s2", "x", "CURRENT ROW", "2 FOLLOWING"), ("q1", "x * x", "3 PRECEDING", "1 PRECEDING"), ("q2", "x * x", "CURRENT ROW", "2 FOLLOWING"))}


@query("SELECT read_id, i, round(CASE WHEN i >= 3 AND i <= n - 3 THEN abs(s2 / 3 - s1 / 3) / sqrt(greatest(q1 / 3 - (s1 / 3) * (s1 / 3) + q2 / 3 - (s2 / 3) * (s2 / 3), 1.17549435e-38) / 3) ELSE 0.0 END, 6) AS t FROM (SELECT read_id, i, count(*) OVER (PARTITION BY read_id) AS n, " + ", ".join(f"{v} AS {k}" for k, v in _s.items()) + f" FROM {SAMPLES})")
def tstat(spark, sf):
    return E.t_statistic(view(spark, sf, "samples"), "read_id", 3).select("read_id", "i", F.round("t", 6).alias("t"))


_model = "(SELECT *, 80 + i % 37 AS level_mean, 1 + i % 5 AS level_stdv FROM {})"


@query(f"SELECT read_id, round(avg(x) - avg(level_mean), 6) AS shift, round((avg(x * x) - 2 * (avg(x) - avg(level_mean)) * avg(x) + (avg(x) - avg(level_mean)) ** 2) / avg(level_mean * level_mean), 6) AS scale FROM {_model.format(SAMPLES)} GROUP BY read_id")
def mom_scaling(spark, sf):
    s = view(spark, sf, "samples").selectExpr("read_id", "cast(x as double) as mean", "cast(80 + i % 37 as double) as level_mean")
    return E.moment_scaling(s, s, "read_id").select("read_id", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale"))


@query(
    f"""SELECT read_id, n, round((a11 * b0 - a01 * b1) / det, 4) AS shift, round((a00 * b1 - a01 * b0) / det, 4) AS scale, n >= 200 AS enough,
 round(sqrt(greatest(c - (a11 * b0 - a01 * b1) / det * b0 - (a00 * b1 - a01 * b0) / det * b1, 0) / n), 3) AS var FROM (SELECT *, a00 * a11 - a01 * a01 AS det FROM
 (SELECT read_id, count(*) AS n, sum(w * x * x) AS c, sum(w) AS a00, sum(w * m) AS a01, sum(w * m * m) AS a11, sum(w * x) AS b0, sum(w * m * x) AS b1 FROM (SELECT read_id, x::DOUBLE AS x, level_mean::DOUBLE AS m, 1 / (level_stdv * level_stdv)::DOUBLE AS w FROM {_model.format(SAMPLES)}) GROUP BY read_id)) WHERE det <> 0"""
)
def wls_recalib(spark, sf):
    s = view(spark, sf, "samples").selectExpr("read_id", "cast(x as double) as mean", "cast(80 + i % 37 as double) as level_mean", "cast(1 + i % 5 as double) as level_stdv")
    return E.recalibration(s, "read_id").select("read_id", "n", F.round("shift", 4).alias("shift"), F.round("scale", 4).alias("scale"), "enough", F.round("var", 3).alias("var"))


@query(f"SELECT read_id, i, CASE WHEN kmer_rank = lag(kmer_rank) OVER (PARTITION BY read_id ORDER BY i) THEN 'E' ELSE 'M' END AS state FROM {PAIRS}")
def state_me(spark, sf):
    return E.match_states(view(spark, sf, "aligned"), "read_id").select("read_id", "i", "state")


@query(f"SELECT read_id, count(*) AS num_events, count_if(coalesce(m = 1, false)) AS num_steps, count_if(coalesce(m > 1 OR m < 0, false)) AS num_skips, count_if(coalesce(m = 0, false)) AS num_stays, CAST(sum(duration) AS BIGINT) AS total_duration FROM (SELECT *, ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY i) AS m FROM {PAIRS}) GROUP BY read_id")
def step_stay_skip(spark, sf):
    return E.move_summary(view(spark, sf, "aligned"), "read_id")


@query(
    f"""SELECT read_id, ref_pos, min(event_index) AS event_index, arg_min(model_kmer, i) AS model_kmer, CAST(sum(length) AS BIGINT) AS length, CASE WHEN sum(length) <> 0 THEN round(CAST(sum(level * length) AS DOUBLE) / CAST(sum(length) AS DOUBLE), 6) ELSE 'nan'::DOUBLE END AS level
 FROM (SELECT *, sum(f) OVER (PARTITION BY read_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM {PAIRS})) GROUP BY read_id, g, ref_pos"""
)
def collapse_events(spark, sf):
    return E.collapse(view(spark, sf, "aligned"), "read_id").drop("island").withColumn("level", F.round("level", 6))


def _mean_sql(column: str) -> str:
    return f"CASE WHEN sum(n) > 0 THEN round(CAST(sum({column} * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) ELSE 'nan'::DOUBLE END"


@query(
    f"""SELECT read_id, ref_pos, arg_min(ref_kmer, i) AS ref_kmer, {_mean_sql("level")} AS event_level_mean, {_mean_sql("stdv")} AS event_stdv,
 {_mean_sql("duration")} AS event_duration, CAST(sum(n) AS BIGINT) AS event_length
 FROM (SELECT *, CASE WHEN ref_kmer = model_kmer THEN length ELSE 0 END AS n, sum(f) OVER (PARTITION BY read_id ORDER BY i) AS g
 FROM (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM {PAIRS})) GROUP BY read_id, g, ref_pos"""
)
def m6anet_collapse(spark, sf):
    out = E.weighted_positions(view(spark, sf, "aligned"), "read_id").drop("island")
    return out.withColumns({c: F.round(c, 6) for c in ("event_level_mean", "event_stdv", "event_duration")})


@query(f"SELECT read_id, ref_pos AS kmer, min(kmer_rank) AS start, max(kmer_rank) AS stop FROM (SELECT *, coalesce(kmer_rank <> lag(kmer_rank) OVER (PARTITION BY read_id ORDER BY i), true) AS fresh FROM {PAIRS}) WHERE fresh GROUP BY read_id, ref_pos")
def base_event_map(spark, sf):
    pairs = view(spark, sf, "aligned").select("read_id", "i", F.col("ref_pos").alias("kmer"), F.col("kmer_rank").alias("event"))
    return E.base_to_event(pairs, "read_id")


@query(FREQ.format(calls=CALLS))
def streaming_meth_freq(spark, sf):
    """The stream reads the events table as files and ends when all are read."""
    from siglake.plans.views import VIEWS
    from siglake.streaming.frequency import run_available

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    calls = stream.selectExpr(*[f"{sql} as `{c}`" for c, sql in VIEWS["methcalls"][1].items()])
    return run_available(spark, calls, "streamed_sites")


from siglake.plans import calling_queries, emit_queries, file_queries, join_queries, kernel_queries  # noqa: E402, F401  registers their queries
