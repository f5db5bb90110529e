"""Query op12_merkle_manifest and its DuckDB SQL."""

from pyspark.sql import functions as F

from siglake.llm.common import LOWER, UPPER, read
from siglake.llm.crc import crc32_sql, crc32_table
from siglake.llm.merkle import ARITY, fold, leaf, manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*changed))
    out = manifest(docs, fields=FIELDS, key="doc_id", group="lang", carry={"tampered": tampered})
    proof = F.sha2(F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), ""), 256)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_f = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_leaf = lambda text: "sha256(concat(" + ", ".join(_f(text if c == "text" else c) for c in FIELDS) + "))"
# trees: 'L' by language, then one over their roots; a tree climbs while it has several nodes
ORACLE = f"""
WITH RECURSIVE t AS (SELECT {crc32_table()} AS t),
d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id", "t.t")} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, t),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
low AS (
  SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL SELECT g, level + 1, i, h, count(*) OVER (PARTITION BY g) FROM (SELECT g, any_value(level) AS level, i // {ARITY} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM low WHERE n > 1 GROUP BY g, i // {ARITY})
),
sub AS (SELECT g, h AS subroot, level AS height FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS i, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, i, h, count(*) OVER () FROM (SELECT any_value(level) AS level, i // {ARITY} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM high WHERE n > 1 GROUP BY i // {ARITY})
),
steps AS (
  SELECT p.g, p.i, x.level AS step, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < p.i // CAST({ARITY}**x.level AS BIGINT)), '') AS a, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > p.i // CAST({ARITY}**x.level AS BIGINT)), '') AS b
  FROM placed p JOIN low x ON x.g = p.g AND x.n > 1 AND x.i // {ARITY} = p.i // CAST({ARITY}**(x.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.g, p.i, s.height + x.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < p.g // CAST({ARITY}**x.level AS BIGINT)), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > p.g // CAST({ARITY}**x.level AS BIGINT)), '')
  FROM placed p JOIN sub s ON s.g = p.g JOIN high x ON x.n > 1 AND x.i // {ARITY} = p.g // CAST({ARITY}**(x.level + 1) AS BIGINT) GROUP BY p.g, p.i, s.height, x.level
),
fold AS (
  SELECT g, i, 0 AS step, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL SELECT g, i, step + 1, sha256(concat(a, h, b)) FROM fold JOIN steps USING (g, i, step)
),
proof AS (SELECT g, i, count(*) AS n, string_agg(a || b, '' ORDER BY step) AS proof FROM steps GROUP BY g, i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN sub USING (g), (SELECT h AS root FROM high WHERE n = 1), (SELECT g AS pg, i AS pi, n AS pn, proof FROM proof RIGHT JOIN placed USING (g, i)) q, fold f
WHERE q.pg = p.g AND q.pi = p.i AND f.g = p.g AND f.i = p.i AND f.step = coalesce(pn, 0)
"""
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": ORACLE}
