"""Query op11_prefix_trie and its DuckDB SQL."""

from pyspark.sql import functions as F

from siglake.llm.common import read
from siglake.llm.crc import crc32_sql, crc32_table
from siglake.llm.trie import ordered_turns, prefix_trie, with_shared_openings

EVERY, OPENINGS = 100, 6


def op11_prefix_trie(spark, sf_dir):
    turns = ordered_turns(read(spark, sf_dir, "conversations"))
    opening = F.crc32(F.col("conv").cast("string")) % OPENINGS
    return prefix_trie(*with_shared_openings(turns, EVERY, opening, OPENINGS - 1))


_digest = "sha256(concat(strlen(role), ':', role, text))"
ORACLE = f"""
WITH t AS (SELECT {crc32_table()} AS t),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, {_digest} AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_digest}) AS pos FROM filled),
ids AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {EVERY} AS base, {crc32_sql("conv_id", "any_value(t.t)")} % {OPENINGS} AS h FROM c, t GROUP BY conv_id),
m AS (SELECT i.conv_id, i.base, i.h, i.n, least(i.h, coalesce(b.n, 0)) AS start FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
r AS (
  SELECT m.conv_id, c.pos AS depth, c.text, c.d FROM m JOIN c ON c.conv_id = m.base AND c.pos <= m.h
  UNION ALL SELECT m.conv_id, m.start + c.pos - m.h, c.text, c.d FROM m JOIN c ON c.conv_id = m.conv_id AND c.pos > m.h
),
p AS (
  SELECT conv_id, depth, length(text) AS size, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, count(*) OVER (PARTITION BY conv_id) = depth AS last FROM r
  UNION ALL SELECT m.conv_id, 0, 0, '', start + greatest(n - h, 0) = 0 FROM m
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends,
    left(path, 64 * (depth - 1)) AS parent FROM p GROUP BY path, depth
),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT a.*, coalesce(k.n, 0) AS n_children FROM nodes a LEFT JOIN kids k ON k.parent = a.path),
below AS (
  SELECT a.top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, left(path, 64 * unnest(range(depth + 1))) AS top FROM full_) a GROUP BY a.top
)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_ x JOIN below ON below.top = x.path LEFT JOIN nodes y ON x.depth > 0 AND y.path = x.parent
"""
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": ORACLE}
