"""Query op13_embedding_links and its DuckDB SQL."""

from siglake.llm.common import read
from siglake.llm.vectors import near_vectors

LEAST = 0.98


def op13_embedding_links(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"), least=LEAST)


ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings
),
d AS (SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e WHERE sound),
link AS (SELECT a.r AS p, b.r AS q FROM d a JOIN d b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / (a.size * b.size) >= {LEAST}),
reach AS (SELECT r, r AS o FROM e UNION SELECT reach.r, link.q FROM reach JOIN link ON link.p = reach.o),
least_ AS (SELECT reach.r, min(o.vec_id) AS c FROM reach JOIN e o ON o.r = reach.o GROUP BY reach.r),
n AS (SELECT p, count(*) AS n FROM link GROUP BY p)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept FROM e JOIN least_ USING (r) LEFT JOIN n ON n.p = e.r
"""
QUERIES = {"op13_embedding_links": op13_embedding_links}
ORACLES = {"op13_embedding_links": ORACLE}
