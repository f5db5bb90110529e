"""Signal tables as views of the driver's tables: the same in Spark (functions) and DuckDB (SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"

#: Order and line number of lineitem are not unique; with part and supplier they nearly always are.
ORDINAL = "(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000)"

#: name: (table, {column: SQL for both engines}); [div] is integer division.
VIEWS = {
    "methcalls": ("events", {
        "chromosome": "event_type", "start": "user_id", "end": "user_id + 5 * (event_id % 3)", "strand": "CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END", "read_name": "CAST(event_id AS STRING)",
        "log_lik_ratio": "(value - CAST(100.0 AS DOUBLE)) / CAST(20.0 AS DOUBLE)", "num_motifs": "1 + event_id % 3", "sequence": "concat('ACTTA', repeat('CGTAA', CAST(1 + event_id % 3 AS INT)), 'CTT')", "row_no": "event_id",
    }),
    "reads": ("documents", {"read_id": "doc_id", "seq": f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''[G])), '{LETTERS}', '{BASES}')", "ord": "doc_id"}),
    "alignments": ("lineitem", {
        "read_id": "l_orderkey", "ord": ORDINAL, "contig": "l_returnflag", "pos": "l_partkey * 10", "ref_end": "l_partkey * 10 + 50 + 10 * l_linenumber", "mapq": "CAST(floor(l_quantity) AS INT)",
        "flag": "CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_discount = 0 THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END",
    }),
    "regions": ("supplier", {"contig": "CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END", "r_start": "(s_suppkey * 7919) % 20000", "r_end": "(s_suppkey * 7919) % 20000 + 300"}),
    "aligned": ("lineitem", {
        "read_id": "l_orderkey", "i": ORDINAL, "ref_pos": "l_linenumber + l_suppkey % 3", "event_index": ORDINAL, "level": "CAST(floor(l_extendedprice) AS BIGINT)", "stdv": "CAST(floor(l_tax * 100) AS BIGINT)", "length": "CAST(floor(l_quantity) AS BIGINT) % 7",
        "ref_kmer": "CASE l_partkey % 2 WHEN 0 THEN 'ACGTA' ELSE 'CGTAC' END", "model_kmer": "CASE l_suppkey % 2 WHEN 0 THEN 'ACGTA' ELSE 'CGTAC' END", "kmer_rank": "l_partkey % 4", "duration": "CAST(floor(l_quantity) AS BIGINT)", "event": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END",
    }),
    "samples": ("embeddings", {"read_id": "vec_id", "x": "embedding"}),
    "summary": ("orders", {"filename": "CAST(o_custkey AS STRING)", "read_id": "o_orderkey"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    d = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "samples":
        return d.selectExpr("vec_id as read_id", "posexplode(transform(embedding, v -> cast(floor(cast(v as double) * 1000) as bigint))) as (i, x)").selectExpr("read_id", "cast(i as bigint) as i", "x")
    return d.selectExpr(*[f"{sql.replace('[G]', '')} as `{c}`" for c, sql in columns.items()])


def view_sql(name: str) -> str:
    """A DuckDB subquery for a view."""
    table, columns = VIEWS[name]
    if name == "samples":
        return "(SELECT vec_id AS read_id, unnest(range(len(embedding))) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS x FROM embeddings)"
    return "(SELECT " + ", ".join(f"{sql.replace('[G]', ", 'g'")} AS \"{c}\"" for c, sql in columns.items()) + f" FROM {table})"
