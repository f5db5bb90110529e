"""Query op7_secrets and its DuckDB SQL."""

from siglake.llm.common import read
from siglake.llm.secrets import KINDS, PATTERNS, REACH, ROLES, scan_secrets


def op7_secrets(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents")).drop("finds")


def _find(kind: str) -> str:
    pattern, least = PATTERNS[kind]
    p = pattern.replace("'", "''")
    return f"""
SELECT r, {KINDS.index(kind)} AS k, s, s + m AS e FROM (
  SELECT r, m, v, sum(g + m) OVER (PARTITION BY r ORDER BY i) - m AS s FROM (
    SELECT r, unnest(range(len(ms))) AS i, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) AS g, unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(vs, lambda x: length(x))) AS v FROM (
      SELECT r, string_split_regex(text, '{p}') AS gs, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', 1) AS vs FROM d
    )
  )
) WHERE v >= {least}"""


_kind = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_role = "CASE {}.k " + " ".join(f"WHEN {i} THEN '{ROLES[k]}'" for i, k in enumerate(KINDS)) + " END"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_find(k) for k in KINDS)}
), kept AS (
  SELECT * FROM f WHERE k < 3 OR (
    EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND {_role.format("g")} <> {_role.format("f")} AND g.s - f.e <= {REACH} AND f.s - g.e <= {REACH})
    AND NOT EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND g.k < 3 AND g.s < f.e AND f.s < g.e))
), per AS (
  SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
    string_agg({_kind} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg({_kind} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""
QUERIES = {"op7_secrets": op7_secrets}
ORACLES = {"op7_secrets": ORACLE}
