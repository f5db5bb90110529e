"""Queries of the output lines, and their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siglake.operators import emit as O
from siglake.operators import events as E
from siglake.plans.registry import ORACLES, PAIRS, query
from siglake.plans.views import view

#: Events of a read laid out along its signal, with some samples between them.
_laid = f"""(SELECT *, stop - duration AS start FROM (SELECT *, row_number() OVER w - 1 + read_id % 3 AS number, CAST(sum(duration + length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
 FROM {PAIRS} WINDOW w AS (PARTITION BY read_id ORDER BY i, ref_pos, duration, length, level)))"""


def laid(spark, sf):
    w = Window.partitionBy("read_id").orderBy("i", "ref_pos", "duration", "length", "level")
    d = view(spark, sf, "aligned").withColumn("stop", F.sum(F.col("duration") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumns({"start": F.col("stop") - F.col("duration"), "number": F.row_number().over(w) - 1 + F.col("read_id") % 3})


@query(f"""
WITH d AS (SELECT *, level / 16::DOUBLE AS x, kmer_rank * 10.5::DOUBLE + 60 AS mean, kmer_rank * 0.5::DOUBLE AS sd FROM {PAIRS})
SELECT concat_ws(chr(9), 'chr1', ref_pos, ref_kmer, read_id, 't', event_index, printf('%.2f', x), printf('%.3f', stdv / 16::DOUBLE), printf('%.5f', duration / 4096::DOUBLE), model_kmer, printf('%.2f', mean), printf('%.2f', sd),
  CASE WHEN sd > 0 THEN printf('%.2f', (x - mean) / (1.5::DOUBLE * sd)) WHEN x > mean THEN 'inf' WHEN x < mean THEN '-inf' ELSE 'nan' END) AS line FROM d""")
def eventalign_lines(spark, sf):
    columns = ["'chr1' as contig", "ref_pos as position", "ref_kmer as reference_kmer", "read_id as read_name", "event_index", "level / 16D as level", "stdv / 16D as stdv", "duration / 4096D as duration", "model_kmer", "kmer_rank * 10.5D + 60 as model_mean", "kmer_rank * 0.5D as model_stdv", "2.25D as var"]
    return O.event_rows(view(spark, sf, "aligned").selectExpr(*columns))


@query(f"""
WITH s AS (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number) THEN 0 ELSE 1 END AS fresh, CASE WHEN ref_kmer = model_kmer THEN length ELSE 0 END AS n FROM {_laid}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS island FROM s),
m AS (SELECT read_id, island, ref_pos, arg_min(ref_kmer, number) AS kmer, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * level) AS DOUBLE) AS a, CAST(sum(n * stdv) AS DOUBLE) AS b, CAST(sum(n * duration) AS DOUBLE) AS c FROM g GROUP BY read_id, island, ref_pos)
SELECT concat_ws(chr(9), 'chr1', ref_pos, kmer, read_id, CASE WHEN total = 0 THEN 'nan' ELSE printf('%.2f', a / total) END, CASE WHEN total = 0 THEN 'nan' ELSE printf('%.3f', b / total) END, CASE WHEN total = 0 THEN 'nan' ELSE printf('%.5f', c / total) END, '') AS line FROM m""")
def m6anet_lines(spark, sf):
    return O.m6anet_rows(E.weighted_positions(laid(spark, sf), "read_id", "number").selectExpr("*", "'chr1' as contig", "read_id as read_name"))


_scaled = f"(SELECT * REPLACE ((level - read_id % 5) / (1 + read_id % 3 / 4::DOUBLE) AS level) FROM {_laid})"


@query(f"""
WITH s AS (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number) THEN 0 ELSE 1 END AS fresh, CASE WHEN ref_kmer = model_kmer THEN length ELSE 0 END AS n FROM {_scaled}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT read_id, ref_pos, CASE WHEN sum(n) = 0 THEN 'nan'::DOUBLE ELSE round(sum(n * level) / sum(n), 6) END AS event_level_mean, CAST(sum(n) AS BIGINT) AS event_length,
  least(arg_min(start, number), arg_max(start, number)) AS start_idx, greatest(arg_min(stop, number), arg_max(stop, number)) AS end_idx FROM g GROUP BY read_id, island, ref_pos""")
def m6anet_positions(spark, sf):
    """Levels brought to the model before they are weighted, and where the run lies on the signal."""
    d = laid(spark, sf).selectExpr("*", "cast(read_id % 5 as double) as shift", "1 + read_id % 3 / 4D as scale")
    out = E.weighted_positions(d, "read_id", "number", scaled=True, indexed=True)
    return out.select("read_id", "ref_pos", F.round("event_level_mean", 6).alias("event_level_mean"), "event_length", "start_idx", "end_idx")


@query(f"""
WITH s AS (SELECT *, ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number) AS move FROM {_laid}),
t AS (SELECT read_id, count(*) AS n, count(*) FILTER (move = 1) AS a, count(*) FILTER (move > 1 OR move < 0) AS b, count(*) FILTER (move = 0) AS c, CAST(sum(duration) AS BIGINT) AS d FROM s GROUP BY read_id)
SELECT concat_ws(chr(9), read_id * 2, read_id, 'slow5', 'dna', 'template', n, a, b, c, printf('%.2f', d / 16::DOUBLE), printf('%.3f', read_id % 7 / 32::DOUBLE), '1.000', '0.000', '1.500') AS line FROM t""")
def summary_lines(spark, sf):
    moves = E.move_summary(laid(spark, sf), "read_id", "number")
    return O.summary_rows(moves.selectExpr("*", "read_id * 2 as read_index", "read_id as read_name", "'slow5' as path", "16 as sample_rate", "read_id % 7 / 32D as shift", "1D as scale", "1.5D as var"))


@query(f"""
WITH s AS (SELECT read_id, number, ref_pos, abs(ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY number)) AS step FROM {_laid}),
o AS (SELECT read_id, number, 0 AS part, 'S' AS op, number AS n FROM s WHERE step IS NULL AND number > 0 UNION ALL SELECT read_id, number, 1, 'D', step - 1 FROM s WHERE step > 1
  UNION ALL SELECT read_id, number, 2, CASE WHEN step = 0 THEN 'I' ELSE 'M' END, 1 FROM s),
g AS (SELECT *, CASE WHEN op = lag(op) OVER (PARTITION BY read_id ORDER BY number, part) THEN 0 ELSE 1 END AS fresh FROM o),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY number, part ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT read_id, run, min(op) AS op, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY read_id, run),
c AS (SELECT read_id, string_agg(concat(n, op), '' ORDER BY run) AS cigar FROM r GROUP BY read_id),
e AS (SELECT read_id, min(ref_pos) AS pos, count(*) AS n FROM s GROUP BY read_id)
SELECT concat_ws(chr(9), concat(read_id, '.template'), CASE WHEN read_id % 2 = 1 THEN 16 ELSE 0 END, 'chr1', pos + 1, 60, cigar, '*', 0, 0, '*', '*', CASE WHEN n > 1 THEN 'ES:i:1' ELSE 'ES:i:-1' END) AS line FROM c JOIN e USING (read_id)""")
def event_sam_lines(spark, sf):
    d = laid(spark, sf).withColumn("event", F.col("number"))
    pos = d.groupBy("read_id").agg(F.min("ref_pos").alias("pos"))
    return O.event_sam_rows(O.event_cigars(d, "read_id", "number").join(pos, "read_id").selectExpr("*", "read_id as read_name", "read_id % 2 = 1 as reverse", "'chr1' as contig", "60 as mapq"))


_path = """
s AS (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY o) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS island FROM s),
t AS (SELECT read_id, island, min(ref_pos) AS ref_pos, min(start) AS a, max(stop) AS z FROM g GROUP BY read_id, island),
u AS (SELECT *, coalesce(abs(ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY island) - CASE WHEN read_id % 2 = 1 THEN -1 ELSE 1 END), 0) AS d, coalesce(a - lag(z) OVER (PARTITION BY read_id ORDER BY island), 0) AS b FROM t),
p AS (SELECT read_id, arg_min(a, island) AS start_raw, arg_max(z, island) AS end_raw, CASE WHEN read_id % 2 = 1 THEN arg_max(ref_pos, island) ELSE arg_min(ref_pos, island) END AS start_kmer,
  CASE WHEN read_id % 2 = 1 THEN arg_min(ref_pos, island) ELSE arg_max(ref_pos, island) END + 1 AS end_kmer, count(*) FILTER (z <> a) AS matches,
  string_agg(concat(CASE WHEN d <> 0 THEN concat(d, 'D') ELSE '' END, CASE WHEN b <> 0 THEN concat(b, 'I') ELSE '' END, CASE WHEN z <> a THEN concat(z - a, ',') ELSE '' END), '' ORDER BY island) AS ss FROM u GROUP BY read_id)"""
#: On the reverse strand the events are numbered against the order of rows, as a read's events run against the reference there.
_against = "(SELECT read_id, ref_pos, start, stop, number AS o FROM {laid})".format(laid=_laid)


def _signal_paths(spark, sf):
    d = laid(spark, sf).selectExpr("read_id", "ref_pos", "start", "stop", "read_id % 2 = 1 as reverse", "case when read_id % 2 = 1 then -number else number end as i")
    return O.signal_paths(d, "read_id")


@query(f"WITH l AS {_against}, {_path} SELECT concat_ws(chr(9), read_id, 100000, start_raw, end_raw, CASE WHEN read_id % 2 = 1 THEN '-' ELSE '+' END, 'chr1', 996, start_kmer, end_kmer, matches, abs(end_kmer - start_kmer), 255, 'sc:f:1.25', 'sh:f:-0.50', concat('ss:Z:', ss)) AS line FROM p")
def paf_lines(spark, sf):
    return O.paf_rows(_signal_paths(spark, sf).selectExpr("*", "read_id as read_name", "100000 as len_raw", "read_id % 2 = 1 as reverse", "'chr1' as contig", "1000 as contig_length", "1.25D as scale", "-0.5D as shift"), 5)


@query(f"WITH l AS {_against}, {_path} SELECT concat_ws(chr(9), read_id, 'record', concat('si:Z:', concat_ws(',', start_raw, end_raw, start_kmer, end_kmer)), concat('ss:Z:', ss), 'sc:f:1.25', 'sh:f:-2') AS line FROM p")
def sam_lines(spark, sf):
    return O.sam_rows(_signal_paths(spark, sf).selectExpr("*", "concat(read_id, '\\t', 'record') as line", "1.25D as scale", "-2D as shift"))


#: A read's k-mers as far as its last row lies, every third row unmapped.
_mapped = f"(SELECT read_id, number - read_id % 3 AS kmer, CASE WHEN kmer_rank = 1 THEN NULL ELSE start END AS start, CASE WHEN kmer_rank = 1 THEN NULL ELSE stop END AS stop FROM {_laid})"


def _kmers(spark, sf, rna=False):
    d = laid(spark, sf)
    sizes = d.groupBy("read_id").agg(F.count("*").alias("n_kmers"))
    return O.resquiggle_kmers(d.where("kmer_rank <> 1").selectExpr("read_id", "number - read_id % 3 as kmer", "start", "stop"), sizes, "read_id", rna)


@query(f"SELECT concat_ws(chr(9), read_id, kmer, coalesce(CAST(start AS VARCHAR), '.'), coalesce(CAST(stop AS VARCHAR), '.')) AS line FROM {_mapped}")
def resquiggle_lines(spark, sf):
    return O.resquiggle_rows(_kmers(spark, sf), "read_id")


@query(f"""
WITH s AS (SELECT *, coalesce(kmer - lag(kmer) OVER w - 1, 0) AS d, coalesce(start - lag(stop) OVER w, 0) AS b FROM {_mapped} WHERE start IS NOT NULL WINDOW w AS (PARTITION BY read_id ORDER BY kmer))
SELECT read_id, min(start) AS start_raw, max(stop) AS end_raw, min(kmer) AS start_kmer, max(kmer) + 1 AS end_kmer, count(*) FILTER (stop <> start) AS matches,
  string_agg(concat(CASE WHEN d <> 0 THEN concat(d, 'D') ELSE '' END, CASE WHEN b <> 0 THEN concat(b, 'I') ELSE '' END, CASE WHEN stop <> start THEN concat(stop - start, ',') ELSE '' END), '' ORDER BY kmer) AS ss FROM s GROUP BY read_id""")
def resquiggle_steps(spark, sf):
    return O.resquiggle_paths(_kmers(spark, sf), "read_id")


@query(
    ORACLES["resquiggle_steps"].rstrip().replace("SELECT read_id, min(start) AS start_raw", "SELECT concat_ws(chr(9), read_id, 100000, start_raw, end_raw, '+', read_id, n_kmers, start_kmer, end_kmer, matches, n_kmers, 255, concat('sc:f:', printf('%.6f', 1 + read_id % 3 / 7::DOUBLE)), concat('sh:f:', printf('%.6f', -(read_id % 5) / 3::DOUBLE)), concat('ss:Z:', ss)) AS line FROM (SELECT read_id, min(start) AS start_raw")
    + f") JOIN (SELECT read_id, count(*) AS n_kmers FROM {PAIRS} GROUP BY read_id) USING (read_id)"
)
def resquiggle_paf_lines(spark, sf):
    """Each read's own scale and shift, not those of another."""
    kmers = _kmers(spark, sf)
    paths = O.resquiggle_paths(kmers, "read_id").join(kmers.groupBy("read_id").agg(F.max("n_kmers").alias("n_kmers")), "read_id")
    return O.resquiggle_paf_rows(paths.selectExpr("*", "100000 as len_raw", "1 + read_id % 3 / 7D as scale", "-(read_id % 5) / 3D as shift"), "read_id")
