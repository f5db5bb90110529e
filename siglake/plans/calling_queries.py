"""Queries around the scoring of reads, and their SQL."""

from pyspark.sql import functions as F

from siglake.functions import signal as S
from siglake.operators import calling as C
from siglake.plans.registry import PAIRS, READS, SAMPLES, SUMMARY, query
from siglake.plans.views import view

_groups = f"(SELECT DISTINCT read_id, ref_pos AS start, ref_pos + 2 AS stop FROM {PAIRS})"


@query(f"""
WITH p AS (SELECT read_id, i, ref_pos, kmer_rank * 20 + ref_pos * 7 AS event FROM {PAIRS}), g AS {_groups},
b AS (
  SELECT read_id, start, stop,
    (SELECT arg_min(event, ref_pos * 1000000000000000 + i) FROM p WHERE p.read_id = g.read_id AND p.ref_pos >= g.start) AS first_event,
    (SELECT arg_min(event, ref_pos * 1000000000000000 + i) FROM p WHERE p.read_id = g.read_id AND p.ref_pos >= g.stop) AS last_event
  FROM g
)
SELECT * FROM b WHERE first_event IS NOT NULL AND last_event IS NOT NULL AND abs(last_event - first_event) > 10""")
def group_event_bounds(spark, sf):
    pairs = view(spark, sf, "aligned")
    groups = pairs.select("read_id", F.col("ref_pos").alias("start"), (F.col("ref_pos") + 2).alias("stop")).distinct()
    return C.event_bounds(pairs.select("read_id", "i", "ref_pos", F.expr("kmer_rank * 20 + ref_pos * 7 as event")), groups, "read_id")


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY read_id, ref_pos ORDER BY i, level) AS up, row_number() OVER (PARTITION BY read_id, ref_pos ORDER BY i DESC, level DESC) AS down, count(*) OVER (PARTITION BY read_id, ref_pos) AS n FROM {PAIRS})
SELECT a.read_id, a.ref_pos AS start, a.ref_pos + a.length AS "end", a.kmer_rank AS num_motifs, a.ref_kmer AS sequence, z.level AS ll_unmethylated, z.duration AS ll_methylated, a.n AS strands_scored, z.duration - z.level AS log_lik_ratio
FROM s a JOIN s z USING (read_id, ref_pos) WHERE a.up = 1 AND z.down = 1""")
def scored_site_map(spark, sf):
    scores = view(spark, sf, "aligned").selectExpr("read_id", "i * 1000000 + level as i", "ref_pos as start", "ref_pos + length as end", "kmer_rank as num_motifs", "ref_kmer as sequence", "level as ll_unmethylated", "duration as ll_methylated")
    return C.site_map(scores, "read_id")


@query(f"SELECT s.read_id, '/data/' || (s.filename::BIGINT % 7) || '/' || s.filename AS path FROM {SUMMARY} s WHERE s.read_id IN (SELECT read_id FROM {READS})")
def read_paths(spark, sf):
    summary = view(spark, sf, "summary").withColumn("read_id", F.col("read_id").cast("bigint"))
    files = summary.select(F.expr("concat('/data/', cast(filename as bigint) % 7, '/', filename)").alias("path")).distinct()
    return C.paths_of_reads(files, summary, view(spark, sf, "reads"))


@query(f"""
WITH v AS (SELECT read_id, list_sort(list(x)) AS o, count(*) AS n FROM {SAMPLES} GROUP BY read_id)
SELECT read_id, o[n // 2 + 1] AS middle, round(list_sort(list_transform(o, lambda x: abs(x - o[n // 2 + 1])))[n // 2 + 1] * 1.4826::DOUBLE, 6) AS spread, round(quantile_cont(x, 0.3), 6) AS low
FROM v JOIN (SELECT read_id, x FROM {SAMPLES}) s USING (read_id) GROUP BY read_id, o, n""")
def signal_statistics(spark, sf):
    """The samples of a read stand in one array, so nothing is shuffled."""
    x = F.expr("transform(embedding, v -> cast(floor(cast(v as double) * 1000) as bigint))")
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("read_id"), x.alias("x"))
    return d.select("read_id", S.upper_median(F.col("x")).alias("middle"), F.round(S.scaled_mad(F.col("x")), 6).alias("spread"), F.round(S.quantile(F.col("x"), 0.3), 6).alias("low"))


@query(f"SELECT avg(length(seq)) AS mean_length FROM {READS}")
def mean_read_length(spark, sf):
    return view(spark, sf, "reads").agg(F.avg(F.length("seq")).alias("mean_length"))
