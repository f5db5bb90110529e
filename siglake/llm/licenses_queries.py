"""Query op5_licenses and its DuckDB SQL."""

from siglake.llm.common import LOWER, UPPER, read
from siglake.llm.licenses import BASE, index, scan_licenses


def op5_licenses(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


_index = index()
_rows = lambda rows: ", ".join(str(tuple(r)) for r in rows)
_phrases = " UNION ALL ".join(f"SELECT r, i, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in BASE.items())
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), base AS ({_phrases}
), b AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r
), need AS (SELECT * FROM (VALUES {_rows((t, x.label, len(x.words), len(x.must)) for t, x in enumerate(_index))}) AS v(t, label, size, musts)
), cells AS (SELECT * FROM (VALUES {_rows((t, j, w, int(j in x.must)) for t, x in enumerate(_index) for j, w in enumerate(x.words))}) AS v(t, j, word, must)
), spots AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d
), checked AS (
  SELECT r, t, i - j AS dg, count(*) AS agree, sum(must) AS musts FROM spots JOIN cells USING (word) GROUP BY ALL HAVING sum(must) > 1
), v AS (
  SELECT r, label, agree / size AS score FROM checked c JOIN need n USING (t) WHERE c.musts = n.musts
), l AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM v UNION ALL SELECT r, label FROM base) GROUP BY r
), s AS (SELECT r, max(score) AS score FROM v GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(score, 0.0::DOUBLE)) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""
QUERIES = {"op5_licenses": op5_licenses}
ORACLES = {"op5_licenses": ORACLE}
