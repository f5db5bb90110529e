"""Queries that join alignments and events with references and signals, and trim pairs; and their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siglake.functions import signal as S
from siglake.operators import emit as O
from siglake.operators import events as E
from siglake.operators import pairs as P
from siglake.operators import reads as R
from siglake.operators import signals as G
from siglake.operators import slices as L
from siglake.plans.registry import ALN, PAIRS, READS, query
from siglake.plans.views import view

_contig = "CASE ord % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"
_ends = "SELECT DISTINCT read_id, ord, contig, (pos * 977) % 300000 AS low, (pos * 977) % 300000 + mapq * 200 AS high FROM {a}"


@query(
    f"""WITH ref AS (SELECT {_contig} AS contig, string_agg(seq, '' ORDER BY ord) AS seq FROM {READS} GROUP BY 1)
 SELECT read_id, ord, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT read_id, ord, CASE WHEN r.seq IS NULL THEN NULL WHEN low >= length(r.seq) THEN '' ELSE substr(r.seq, low + 1, high - low + 1) END AS s
 FROM ({_ends.format(a=ALN)}) LEFT JOIN ref r USING (contig))"""
)
def reference_slices(spark, sf):
    """The bases under every alignment; contigs are lines in order, alignments lie over ends of tiles and of contigs."""
    lines = view(spark, sf, "reads").selectExpr(f"{_contig} as contig", "ord", "seq")
    alignments = view(spark, sf, "alignments").selectExpr("read_id", "ord", "contig", "(pos * 977) % 300000 as pos", "(pos * 977) % 300000 + mapq * 200 as ref_end")
    out = L.reference_slices(alignments.distinct(), L.placed_lines(lines), ["read_id", "ord", "contig", "pos", "ref_end"], tile=4096, asked=L.extents(alignments))
    return out.select("read_id", "ord", F.length("ref_seq").cast("bigint").alias("n"), F.md5("ref_seq").alias("digest"))


_signal = "CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT)"


def signals(spark, sf):
    x = f"transform(embedding, v -> {_signal.lower()}) as samples"
    return spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as read_id", x, "cast(1000 as double) as sample_rate")


_signals = f"(SELECT vec_id AS read_id, list_transform(embedding, lambda v: {_signal}) AS samples FROM embeddings)"


@query(f"SELECT read_id, ord, CAST(len(samples) AS BIGINT) AS n, CAST(list_sum(samples) AS BIGINT) AS total FROM {ALN} JOIN {_signals} USING (read_id)")
def aln_signals(spark, sf):
    """Alignments with their reads' signals, of which only those that match are shuffled."""
    out = G.with_signals(view(spark, sf, "alignments").select("read_id", "ord"), signals(spark, sf))
    return out.select("read_id", "ord", F.size("samples").cast("bigint").alias("n"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query(f"SELECT a.read_id, a.ord, p.path FROM {ALN} a LEFT JOIN (SELECT o_orderkey AS read_id, arg_max(concat('/p/', o_custkey), o_totalprice * 1000000 + o_custkey) AS path FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1) p USING (read_id)")
def aln_paths(spark, sf):
    """Alignments with their reads' paths, of several the last; those without one stay to be counted."""
    index = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 4 > 0").selectExpr("o_orderkey as read_id", "concat('/p/', o_custkey) as path", "o_totalprice * 1000000 + o_custkey as ord")
    return R.with_paths(view(spark, sf, "alignments").select("read_id", "ord"), R.last_paths(index), "keep")


_order = "ord, ref_pos, level, stdv, duration"
_events = f"""(SELECT *, (number % 6) * 9 + read_id % 3 AS start, 1 + duration % 8 AS length FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY {_order}) - 1 AS number
 FROM (SELECT read_id, i AS ord, ref_pos, event_index, model_kmer, CAST(level AS DOUBLE) AS level, CAST(stdv AS DOUBLE) AS stdv, duration FROM {{pairs}})))"""


@query(
    f"""WITH e AS (SELECT *, start + length AS stop FROM {_events.format(pairs=PAIRS)}),
 f AS (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number) THEN 0 ELSE 1 END AS fresh FROM e),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS island FROM f),
 r AS (SELECT read_id, island, ref_pos, arg_min(event_index, number) AS event_index, arg_min(model_kmer, number) AS model_kmer, count(*) AS n, arg_min(level, number) AS level, arg_min(stdv, number) AS stdv,
  least(arg_min(start, number), arg_max(start, number)) AS a, greatest(arg_min(stop, number), arg_max(stop, number)) AS z FROM g GROUP BY ALL),
 s AS (SELECT *, list_slice(samples, a + 1, z) AS part FROM r JOIN {_signals} USING (read_id))
 SELECT read_id, ref_pos, event_index, model_kmer, a AS start_idx, z AS end_idx, round(CASE WHEN n > 1 THEN list_avg(part) ELSE level END, 6) AS mean, round(CASE WHEN n > 1 THEN list_aggregate(part, 'stddev_pop') ELSE stdv END, 6) AS stdv, (z - a) / 1000::DOUBLE AS duration FROM s"""
)
def collapse_raw(spark, sf):
    """Runs of rows at one position measured anew on the samples."""
    w = Window.partitionBy("read_id").orderBy(*_order.split(", "))
    d = view(spark, sf, "aligned").selectExpr("read_id", "i as ord", "ref_pos", "event_index", "model_kmer", "cast(level as double) as level", "cast(stdv as double) as stdv", "duration")
    d = d.withColumn("i", F.row_number().over(w) - 1).selectExpr("read_id", "i", "ref_pos", "event_index", "model_kmer", "level as mean", "stdv", "i % 6 * 9 + read_id % 3 as start", "1 + duration % 8 as length")
    return G.collapse_raw(d, signals(spark, sf)).withColumns({"mean": F.round("mean", 6), "stdv": F.round("stdv", 6)})


_pairs = f"""(SELECT read_id, low, low + 90 AS high, 40 + read_id % 30 AS kmer, list_transform(range(len(samples)), lambda i: {{'ref_pos': 3 * i + abs(samples[i + 1]) % 3, 'read_pos': 2 * i + abs(samples[i + 1]) % 2}}) AS p
 FROM (SELECT *, 20 + read_id % 40 AS low FROM {_signals}))"""


@query(
    f"""WITH p AS (SELECT * FROM {_pairs}), t AS (SELECT *, list_filter(p, lambda x: x.ref_pos >= low AND x.ref_pos <= high) AS region, list_filter(p, lambda x: x.read_pos <= kmer) AS kmers,
 list_filter(p, lambda x: x.read_pos >= 6 AND x.read_pos + 6 < 100) AS inside FROM p)
 SELECT read_id, len(region)::BIGINT AS n_region, region[1].ref_pos AS first_ref, region[-1].ref_pos AS last_ref, len(kmers)::BIGINT AS n_kmers, kmers[-1].read_pos AS last_read,
 (len(list_filter(p, lambda x: x.ref_pos <= high)) - 1)::BIGINT AS end_pair, len(inside)::BIGINT AS n_inside,
 CASE WHEN inside[1].read_pos // (1 + read_id % 4 * 40) = inside[-1].read_pos // (1 + read_id % 4 * 40) THEN 0 ELSE len(inside) END::BIGINT AS n_used FROM t"""
)
def trimmed_pairs(spark, sf):
    """Pairs of every read cut to a region and to a last k-mer, without those near its ends, none of a degenerate read; all in the row."""
    made = F.transform("samples", lambda v, i: F.struct((3 * i + F.abs(v) % 3).alias("ref_pos"), (2 * i + F.abs(v) % 2).alias("read_pos")))
    d = signals(spark, sf).select("read_id", made.alias("p"), (20 + F.col("read_id") % 40).alias("low"))
    high, last = F.col("low") + 90, F.lit(40) + F.col("read_id") % 30
    p = F.col("p")
    d = d.select("read_id", P.trim_to_region(p, F.col("low"), high).alias("region"), P.trim_to_kmer(p, last).alias("kmers"), P.end_pair(p, high, F.lit(3)).alias("end_pair"), P.inner_pairs(p, F.lit(6), F.lit(100)).alias("inside"))
    mapped = F.transform("inside", lambda x: F.struct(x["ref_pos"].alias("ref_pos"), F.floor(x["read_pos"] / (1 + F.col("read_id") % 4 * 40)).alias("event")))
    size = lambda c: F.size(c).cast("bigint")
    return d.select(
        "read_id", size("region").alias("n_region"), F.get("region", F.lit(0))["ref_pos"].alias("first_ref"), F.get("region", F.size("region") - 1)["ref_pos"].alias("last_ref"),
        size("kmers").alias("n_kmers"), F.get("kmers", F.size("kmers") - 1)["read_pos"].alias("last_read"), F.col("end_pair").cast("bigint").alias("end_pair"),
        size("inside").alias("n_inside"), size(P.unless_degenerate(mapped)).alias("n_used"),
    )


_model = "(SELECT 'ACGTA' AS model_kmer, 70.5::DOUBLE AS model_mean, 2.5::DOUBLE AS model_stdv UNION ALL SELECT 'CGTAC', 60.25, 0.0)"
_chain = f"""WITH e AS (SELECT *, start + length AS stop, CASE WHEN number % 5 = 4 THEN 'B' ELSE 'M' END AS hmm_state FROM {_events.format(pairs=PAIRS)} JOIN (SELECT DISTINCT read_id AS r FROM {_signals}) ON r = read_id),
 f AS (SELECT *, CASE WHEN {{fresh}} THEN 1 ELSE 0 END AS fresh FROM e),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS island FROM f),
 r AS (SELECT read_id, island, ref_pos, arg_min(event_index, number) AS event_index, arg_min(model_kmer, number) AS model_kmer, arg_min(hmm_state, number) AS s, count(*) AS n, arg_min(level, number) AS level, arg_min(stdv, number) AS stdv,
  least(arg_min(start, number), arg_max(start, number)) AS a, greatest(arg_min(stop, number), arg_max(stop, number)) AS z FROM g GROUP BY ALL),
 p AS (SELECT *, list_slice(samples, a + 1, z) AS part, read_id % 7::DOUBLE AS shift, 1 + read_id % 3 / 4::DOUBLE AS scale, 1.5::DOUBLE AS var FROM r JOIN {_signals} USING (read_id) JOIN {_model} USING (model_kmer)),
 q AS (SELECT *, CASE WHEN n > 1 THEN list_avg(part) ELSE level END AS x, CASE WHEN n > 1 THEN list_aggregate(part, 'stddev_pop') ELSE stdv END AS sd FROM p),
 t AS (SELECT *, {{level}} AS l, CASE WHEN s = 'B' THEN 0 ELSE {{mean}} END AS m, CASE WHEN s = 'B' THEN 0 ELSE {{dev}} END AS d FROM q)
 SELECT concat_ws(chr(9), 'chr1', ref_pos, 'NNNNN', read_id, 't', event_index, printf('%.2f', l), printf('%.3f', sd), printf('%.5f', (z - a) / 1000::DOUBLE), model_kmer, printf('%.2f', m), printf('%.2f', d),
 CASE WHEN d > 0 THEN printf('%.2f', (l - m) / (sqrt(var) * d)) WHEN l > m THEN 'inf' WHEN l < m THEN '-inf' ELSE 'nan' END, a, z{{samples}}) AS line FROM t"""


def chained(spark, sf, **options):
    w = Window.partitionBy("read_id").orderBy(*_order.split(", "))
    d = view(spark, sf, "aligned").selectExpr("read_id", "i as ord", "ref_pos", "event_index", "model_kmer", "cast(level as double) as level", "cast(stdv as double) as stdv", "duration")
    d = d.withColumn("i", F.row_number().over(w) - 1).selectExpr(
        "read_id", "i", "'chr1' as contig", "ref_pos", "'NNNNN' as ref_kmer", "cast(read_id as string) as read_name", "event_index", "model_kmer", "CASE WHEN i % 5 = 4 THEN 'B' ELSE 'M' END as hmm_state",
        "i % 6 * 9 + read_id % 3 as start", "1 + duration % 8 as length", "level as mean", "stdv",
    )
    scalings = signals(spark, sf).selectExpr("read_id", "cast(read_id % 7 as double) as shift", "1 + read_id % 3 / 4D as scale", "1.5D as var")
    model = spark.createDataFrame([("ACGTA", 70.5, 2.5), ("CGTAC", 60.25, 0.0)], "model_kmer string, model_mean double, model_stdv double")
    return O.event_lines(d, signals(spark, sf), scalings, model, signal_index=True, **options).select("line")


@query(
    _chain.format(
        fresh="(ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number)) IS NOT TRUE",
        level="(x - shift) / scale", mean="model_mean", dev="model_stdv", samples=", array_to_string(list_transform(part, lambda v: printf('%g', CAST((v - shift) / scale AS FLOAT))), ',')",
    )
)
def eventalign_collapsed(spark, sf):
    """From pairs, signals and model to lines: runs on samples, levels in units of the model, indexes and samples."""
    return chained(spark, sf, collapse=True, scale_events=True, samples=True)


@query(_chain.format(fresh="true", level="x", mean="scale * model_mean + shift", dev="model_stdv * var", samples=""))
def eventalign_unscaled(spark, sf):
    """Every event a line, the model in units of the read."""
    return chained(spark, sf)


@query(
    f"""WITH p AS (SELECT read_id, max(event) - min(event) AS span FROM {PAIRS} WHERE event IS NOT NULL GROUP BY read_id), k AS (SELECT read_id, count(*) AS n FROM {PAIRS} GROUP BY read_id)
 SELECT read_id, round(span / n::DOUBLE, 6) AS events_per_base FROM p JOIN k USING (read_id)"""
)
def events_per_base(spark, sf):
    d = view(spark, sf, "aligned")
    out = E.events_per_base(d.where("event is not null").select("read_id", "event"), d.groupBy("read_id").agg(F.count("*").alias("n_kmers")), "read_id")
    return out.withColumn("events_per_base", F.round("events_per_base", 6))


_codes = "ACGTMRWSYKVHDBN"
_kmer = "concat(" + ", ".join(f"substr('{_codes}', CAST(1 + {x} AS INT), 1)" for x in ("l_partkey % 15", "l_suppkey % 15", "l_orderkey % 15")) + ")"


@query(
    f"""WITH k AS (SELECT DISTINCT {_kmer} AS kmer FROM lineitem), s AS (SELECT unnest({[*S.SYMBOLS]}) AS c, unnest({[*S.SYMBOLS.values()]}) AS b), t AS (SELECT c, unnest(string_split(b, '')) AS b FROM s)
 SELECT kmer, string_agg(x.b || y.b || z.b, ',' ORDER BY x.b || y.b || z.b) AS expanded, length(regexp_replace(kmer, '[ACGT]', '', 'g')) AS n_ambiguous, true AS valid
 FROM k JOIN t x ON x.c = kmer[1] JOIN t y ON y.c = kmer[2] JOIN t z ON z.c = kmer[3] GROUP BY kmer"""
)
def iupac_expand(spark, sf):
    """Every k-mer of ambiguity codes and all it stands for."""
    d = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(f"{_kmer} as kmer").distinct()
    k = F.col("kmer")
    return d.select("kmer", F.array_join(S.expansions(k), ",").alias("expanded"), S.ambiguous_count(k).alias("n_ambiguous"), S.is_valid(k).alias("valid"))


_halves = f"(SELECT read_id, CASE WHEN read_id % 2 = 0 THEN replace(seq, 'CG', 'MG') ELSE replace(seq, 'ACG', 'AMG') END || CASE WHEN read_id % 3 = 0 THEN 'M' ELSE '' END AS seq FROM {READS})"


@query(f"SELECT read_id, reverse(translate(replace(seq, 'MG', '12'), 'ACGT12M', 'TGCAGMG')) AS other FROM {_halves}")
def methylated_strand(spark, sf):
    """The other strand of reads in which some sites are methylated and some end within a site."""
    half = "CASE WHEN read_id % 2 = 0 THEN replace(seq, 'CG', 'MG') ELSE replace(seq, 'ACG', 'AMG') END || CASE WHEN read_id % 3 = 0 THEN 'M' ELSE '' END as seq"
    return view(spark, sf, "reads").selectExpr("read_id", half).select("read_id", S.reverse_complement_methylated(F.col("seq")).alias("other"))


_groups = "SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) - 1 AS read_group, CASE o_orderkey % 4 WHEN 0 THEN 'rna' WHEN 1 THEN 'genomic_dna' WHEN 2 THEN 'other' END AS experiment_type, CASE o_orderkey % 5 WHEN 0 THEN 'sqk-lsk114' WHEN 1 THEN 'sqk-rna004' WHEN 2 THEN 'sqk-lsk109' WHEN 3 THEN 'sqk-lsk114' END AS sequencing_kit FROM {t}"


@query(
    f"""WITH g AS ({_groups.format(t="orders")}), z AS (SELECT * FROM g WHERE read_group = 0),
 m AS (SELECT z.file, bool_or(z.experiment_type IS NOT NULL AND g.experiment_type IS DISTINCT FROM z.experiment_type) AS e, bool_or(z.sequencing_kit IS NOT NULL AND g.sequencing_kit IS DISTINCT FROM z.sequencing_kit) AS k FROM z JOIN g USING (file) GROUP BY z.file)
 SELECT file, coalesce(experiment_type = 'rna', false) AS rna, CASE WHEN sequencing_kit LIKE '%114%' THEN 'r10' WHEN sequencing_kit LIKE '%rna004%' THEN 'rna004' ELSE 'r9' END AS pore,
 concat_ws(',', CASE WHEN experiment_type IS NULL THEN 'no experiment type' WHEN experiment_type = 'other' THEN 'unknown experiment type' END, CASE WHEN e THEN 'experiment types differ' END, CASE WHEN sequencing_kit IS NULL THEN 'no sequencing kit' END, CASE WHEN k THEN 'sequencing kits differ' END) AS warnings FROM z JOIN m USING (file)"""
)
def detected_runs(spark, sf):
    """Molecule and pore of every file of signals from its header, and what is odd in it."""
    groups = spark.sql(_groups.format(t="{t}"), t=spark.read.parquet(f"{sf}/orders.parquet"))
    return S.detect_run(groups).withColumn("warnings", F.array_join("warnings", ","))
