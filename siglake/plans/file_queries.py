"""Queries that go through files, laid out and written by Spark from the views, and their SQL."""

from pyspark.sql import functions as F

from siglake.operators import frequency as Q
from siglake.operators import run as run_
from siglake.plans.registry import CALLS, FREQ, ORACLES, READS, _compared, query
from siglake.plans.views import view
from siglake.sources import layout, tables
from siglake.sources.lines import numbered_lines
from siglake.sources.shared import shared_folder
from siglake.streaming import merge

#: Calls as they stand in a file, their scores with two digits.
_printed = f"(SELECT * REPLACE (CAST(printf('%.2f', log_lik_ratio) AS DOUBLE) AS log_lik_ratio) FROM {CALLS})"


def as_calls(calls):
    """The view's calls with all columns of the file."""
    return calls.selectExpr("chromosome", "strand", "start", "end", "read_name", "log_lik_ratio", "log_lik_ratio as log_lik_methylated", "0D as log_lik_unmethylated", "1 as num_calling_strands", "num_motifs", "sequence", "row_no")


@query(FREQ.format(calls=_printed))
def meth_freq_files(spark, sf):
    """Calls written in order as a folder of part files, read again by the strict reader and aggregated; first seen is by line."""
    path = shared_folder(spark, "calls")
    tables.write_calls(as_calls(view(spark, sf, "methcalls")), path, order=["row_no"], partitions=5)
    return Q.site_frequency(tables.read_calls(spark, path))


_site_calls = CALLS.replace('user_id AS "start"', 'user_id * 10 + 3 * (event_id % 3) AS "start"').replace('user_id + 5 * (event_id % 3) AS "end"', 'user_id * 10 + 8 * (event_id % 3) AS "end"')
_site_file = lambda k: "(" + FREQ.format(calls=f"(SELECT * FROM {_site_calls} WHERE start % 3 = {k} OR row_no % 4 = {k})") + ")"
_all_files = " UNION ALL ".join(f"SELECT *, {k} AS file FROM {_site_file(k)}" for k in range(3))
#: A position has one site here, so the sequences of files agree.
_merged = f"""SELECT chromosome, start, arg_max("end", file) AS "end", arg_max(num_motifs_in_group, file) AS num_motifs_in_group, CAST(sum(called_sites) AS BIGINT) AS called_sites, CAST(sum(called_sites_methylated) AS BIGINT) AS called_sites_methylated,
 CASE WHEN count(*) = 1 THEN min(methylated_frequency) ELSE CAST(sum(called_sites_methylated) AS DOUBLE) / CAST(sum(called_sites) AS DOUBLE) END AS methylated_frequency, min(group_sequence) AS group_sequence FROM ({_all_files}) GROUP BY chromosome, start"""


def site_files(spark, sf):
    calls = view(spark, sf, "methcalls").withColumns({"start": F.expr("cast(start * 10 + 3 * (row_no % 3) as bigint)"), "end": F.expr("cast(start * 10 + 8 * (row_no % 3) as bigint)")})
    return [Q.site_frequency(calls.where(f"start % 3 = {k} or row_no % 4 = {k}")) for k in range(3)]


@query(_merged)
def freq_merge_sequences(spark, sf):
    """Merged files whose sites have one sequence in all of them; others end the job."""
    return Q.merge_frequencies(site_files(spark, sf))


@query(
    f"""SELECT row_number() OVER (ORDER BY chromosome, start) AS line_no, concat_ws(chr(9), chromosome, start, "end", num_motifs_in_group, called_sites, called_sites_methylated, printf('%.3f', methylated_frequency), group_sequence) AS line FROM ({_merged})
 UNION ALL SELECT 0, '{tables.FREQ_HEADERS[0]}'"""
)
def freq_merge_text(spark, sf):
    """Three tables from files to one file in order: part files one after the other, one header, which is that of the last input."""
    paths = [shared_folder(spark, f"freq{k}") for k in range(3)]
    for k, (f, path) in enumerate(zip(site_files(spark, sf), paths)):
        tables.write_frequencies(f, path, tables.FREQ_HEADERS[k < 2], partitions=3)
    out = shared_folder(spark, "merged")
    tables.merge_frequency_files(spark, paths, out, partitions=4)
    return numbered_lines(spark, out).select(F.col("row_no").alias("line_no"), F.col("value").alias("line"))


@query(FREQ.format(calls=CALLS))
def incremental_freq(spark, sf):
    """Five files of calls, each a batch of a stream; one of the batches is run again."""
    calls, source, state = view(spark, sf, "methcalls"), shared_folder(spark, "arriving"), shared_folder(spark, "state")
    n = calls.agg(F.max("row_no")).first()[0] or 0
    batch = lambda k: calls.where((F.col("row_no") * 5 >= k * (n + 1)) & (F.col("row_no") * 5 < (k + 1) * (n + 1)))
    for k in range(5):
        batch(k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    merge.stream_into(stream, state, shared_folder(spark, "stream")).awaitTermination()
    merge.add_batch(batch(2), 2, state)
    return merge.merged_frequency(spark, state)


@query(ORACLES["region_scan"])
def region_pruned(spark, sf):
    """A region of alignments laid out by region: only the partitions of the bins that overlap it are read."""
    path = shared_folder(spark, "by-region")
    layout.write_by_region(view(spark, sf, "alignments"), path, finest=10)
    return layout.read_region(spark, path, "N", 5000, 9000, finest=10).select("read_id", "ord", "pos")


_status = "CASE WHEN l_partkey % 11 = 0 THEN 1 WHEN l_partkey % 7 = 0 THEN 2 WHEN l_partkey % 5 = 0 THEN 4 ELSE 0 END"
_samples = "CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END"
_run = f"""SELECT CASE WHEN mapq < 20 THEN 'low_mapq' WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN n_bases > 6000 THEN 'long' WHEN n_samples IS NULL THEN 'missing'
 WHEN status = 1 THEN 'bad_calibration' WHEN status = 2 THEN 'bad_alignment' WHEN status = 4 THEN 'bad_quality' ELSE 'written' END AS o, n_bases
 FROM (SELECT CAST(floor(l_quantity) AS INT) AS mapq, CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_discount = 0 THEN 4 ELSE 0 END AS flag, l_partkey % 1000 * 7 AS n_bases, {_samples} AS n_samples, {_status} AS status FROM lineitem)"""
_names = [c for c in run_.COUNTERS if c not in ("total", "bases")]


@query(
    f"""WITH r AS ({_run}), c AS (SELECT count_if(o NOT IN ('low_mapq', 'unmapped', 'secondary')) AS total, {", ".join(f"count_if(o = '{c}') AS {c}" for c in _names)},
 CAST(coalesce(sum(n_bases) FILTER (o NOT IN ('low_mapq', 'unmapped', 'secondary', 'long', 'missing')), 0) AS BIGINT) AS bases FROM r), f AS (SELECT *, bad_quality + bad_calibration + bad_alignment AS failed FROM c)
 SELECT * EXCLUDE failed, low_mapq > total AS warn_mapq, failed > total // 2 AS warn_failed, missing * 10 > total AS warn_missing, failed + missing >= total AS error_all_failed, total = 0 AS error_empty FROM f"""
)
def run_counters(spark, sf):
    """The counters and checks of a run, observed while it writes the alignments it keeps."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as read_id", "cast(floor(l_quantity) as int) as mapq", "case when l_linenumber = 7 then 256 else 0 end + case when l_discount = 0 then 4 else 0 end as flag",
        "l_partkey % 1000 * 7 as n_bases", f"{_samples} as n_samples", f"{_status} as status",
    )
    return run_.run(rows, shared_folder(spark, "run"), long=6000)


_bins = f"(SELECT *, length(seq) // 1000 * 1000 AS bin FROM (SELECT DISTINCT read_id, seq FROM {READS}))"


@query(
    f"""WITH b AS (SELECT * FROM {_bins}), t AS (SELECT DISTINCT bin AS top FROM b)
 SELECT 'accumulate' AS mode, concat('0k_', top // 1000, 'k') AS file, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM b JOIN t ON bin < top GROUP BY top
 UNION ALL SELECT 'bins', concat(bin // 1000, 'k_', bin // 1000 + 1, 'k'), count(*), CAST(sum(length(seq)) AS BIGINT) FROM b GROUP BY bin
 UNION ALL SELECT 'limit', concat(bin // 1000, 'k_', bin // 1000 + 1, 'k'), count(*), CAST(sum(length(seq)) AS BIGINT) FROM b WHERE bin < 1000 GROUP BY bin
 UNION ALL SELECT 'range', '1k_3k', count(*), CAST(sum(length(seq)) AS BIGINT) FROM b WHERE bin BETWEEN 1000 AND 3000 HAVING count(*) > 0"""
)
def length_groups(spark, sf):
    """Reads by groups of lengths in every way there is."""
    reads, out = view(spark, sf, "reads"), None
    for mode, options in (("bins", {}), ("limit", {"high": 1000}), ("range", {"low": 1000, "high": 3000}), ("accumulate", {})):
        groups = layout.grouped_by_length(reads, mode=mode, **options).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("bigint").alias("bases"))
        groups = groups.select(F.lit(mode).alias("mode"), "file", "n", "bases")
        out = groups if out is None else out.union(groups)
    return out


@query(f"SELECT read_id, n FROM (SELECT read_id, length(seq) AS n, sum(length(seq)) OVER (ORDER BY ord) AS s FROM {READS}) WHERE s <= 100000")
def first_bases(spark, sf):
    """The first reads of up to 100,000 bases together."""
    return layout.take_bases(view(spark, sf, "reads"), 100_000).select("read_id", F.length("seq").cast("bigint").alias("n"))


_bed = f"""SELECT chromosome, start - back AS start, CAST(sum(coverage) AS BIGINT) AS depth, CAST(sum(CAST(trunc((percent / 100) * coverage) AS BIGINT)) AS BIGINT) AS methylated
 FROM (SELECT chromosome, start, CASE WHEN strand = '-' THEN 1 ELSE 0 END AS back, num_motifs * 7 AS coverage, CAST(row_no % 101 AS DOUBLE) AS percent FROM {CALLS}) GROUP BY ALL"""


@query(
    f"""WITH b AS ({_bed}), f AS ({FREQ.format(calls=CALLS)}),
 j AS (SELECT f.chromosome, f.start, f.called_sites, f.methylated_frequency, b.depth, b.methylated / b.depth::DOUBLE AS frequency FROM f JOIN b ON f.chromosome = b.chromosome AND f.start = b.start AND f."end" = b.start WHERE f.num_motifs_in_group = 1 AND called_sites > 0 AND depth > 0)
 SELECT row_number() OVER (ORDER BY chromosome, start) AS line_no, concat_ws(chr(9), concat(chromosome, ':', start, '-', start), called_sites, printf('%.4f', methylated_frequency), depth, printf('%.4f', frequency)) AS line FROM j
 UNION ALL SELECT 0, concat_ws(chr(9), 'key', 'depth_1', 'frequency_1', 'depth_2', 'frequency_2')"""
)
def bedmethyl_compare_text(spark, sf):
    """A bedMethyl file against frequencies, as the lines of the comparison; the file is read with its white space."""
    calls, path, out = view(spark, sf, "methcalls"), shared_folder(spark, "bedmethyl"), shared_folder(spark, "compared")
    cells = ["chromosome", "start", "start + 1", "'m'", "1000", "strand", "start", "start + 1", "'255,0,0'", "num_motifs * 7", "row_no % 101"]
    calls.selectExpr(f"concat_ws('  ', {', '.join(cells)}) as line").write.text(path)
    sites = Q.accumulate_bedmethyl(tables.read_bedmethyl(spark, path))
    second = sites.selectExpr("chromosome", "start", "end", "1 as num_motifs_in_group", "depth as called_sites", "methylated / depth as methylated_frequency").where("called_sites > 0")
    tables.write_compared(Q.compare_frequencies(Q.site_frequency(calls), second), out, partitions=3)
    return numbered_lines(spark, out).select(F.col("row_no").alias("line_no"), F.col("value").alias("line"))


@query(f"""WITH h AS (SELECT bin_1, bin_2, n FROM ({ORACLES["freq_hist2d"]})) SELECT bin_1, bin_2, n, round(log10(n), 6) AS fill FROM h""")
def freq_hist2d_log(spark, sf):
    """The heat map of the comparison, with the logarithm that colours it."""
    return Q.histogram_2d(_compared(spark, sf)).withColumn("fill", F.round(F.log10("n"), 6))


@query(
    """WITH a AS (SELECT o_orderkey AS read_id, concat('/a/', o_custkey) AS path, 0 AS k FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, concat('/b/', o_custkey), 1 FROM orders WHERE o_orderkey % 3 > 0),
 m AS (SELECT read_id, arg_max(path, (k, path)) AS path FROM a GROUP BY read_id)
 SELECT row_number() OVER (ORDER BY read_id::VARCHAR) - 1 AS line_no, concat(read_id, chr(9), path) AS line FROM m"""
)
def read_index_merged(spark, sf):
    """Two indexes of reads, written apart, as one sorted by read; a read of both has the second's path."""
    o, paths, out = spark.read.parquet(f"{sf}/orders.parquet"), [shared_folder(spark, f"index{k}") for k in range(2)], shared_folder(spark, "index")
    for k, (where, path) in enumerate(zip(("o_orderkey % 3 < 2", "o_orderkey % 3 > 0"), paths)):
        rows = o.where(where).groupBy("o_orderkey").agg(F.max(F.concat(F.lit(f"/{'ab'[k]}/"), "o_custkey")).alias("path"))
        tables.write_read_index(rows.select(F.col("o_orderkey").cast("string").alias("read_id"), "path"), path)
    tables.merge_read_indexes(spark, paths, out)
    return numbered_lines(spark, out).select(F.col("row_no").alias("line_no"), F.col("value").alias("line"))
