"""Query op10_decontaminate and its DuckDB SQL."""

from siglake.llm.common import read
from siglake.llm.decontaminate import decontaminate

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"]


def op10_decontaminate(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10).select(*COLUMNS)


_words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, row_number() OVER () AS q, {_words} AS w FROM benchmark),
windows AS (
  SELECT item_id, q, i, array_to_string(w[i:i + n - 1], ' ') AS g, n FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
),
found AS (SELECT p.r, p.i, p.n, x.item_id, x.q, x.i AS j FROM places p JOIN windows x ON p.g = x.g AND p.n = x.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
islands AS (SELECT r, q, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, q, i - j ORDER BY i) AS island, n FROM (SELECT DISTINCT r, q, i, j, n FROM found)),
longest AS (SELECT r, max(m) AS m FROM (SELECT r, q, diagonal, island, max(n) + count(*) - 1 AS m FROM islands GROUP BY ALL) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(m, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""
QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {"op10_decontaminate": ORACLE}
