"""Query op1_quality_rules and its DuckDB SQL."""

from siglake.llm.common import read
from siglake.llm.rules import METRICS, quality_rules, sketch_value, within_sql

WEIGHT = 100


def op1_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"), weight=WEIGHT)


_stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {sql.replace(' div ', ' // ')} AS v FROM counts WHERE n_words > 0" for m, (sql, _, _) in METRICS.items())
_fences = ", ".join(f"max(CASE WHEN metric = '{m}' THEN 4 * q3 - 3 * q1 + {slack} END) AS hi_{m}, max(CASE WHEN metric = '{m}' THEN {f'4 * q1 - 3 * q3 - {slack}' if both else -1} END) AS lo_{m}" for m, (_, slack, both) in METRICS.items())
_cut = sketch_value("v", "", "").replace("((v, ", "((v >> ").replace("), greatest", ") << greatest")

ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r
  FROM documents
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut)
), dup AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), counts AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-ZÀ-Þ]', '', 'g')))::BIGINT AS n_capitals
  FROM cut LEFT JOIN rep USING (r)
), vals AS ({_stacked}
), cut_vals AS (
  SELECT lang, source, metric, {_cut} AS v FROM vals
), s AS (
  SELECT lang, source, metric, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM cut_vals GROUP BY ALL
), l AS (
  SELECT lang, metric, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM cut_vals GROUP BY ALL
), c AS (
  SELECT metric, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM cut_vals GROUP BY ALL
), q AS (
  SELECT s.lang, s.source, s.metric, (s.n * s.q1 + {WEIGHT} * ((l.n * l.q1 + {WEIGHT} * c.q1) // (l.n + {WEIGHT}))) // (s.n + {WEIGHT}) AS q1, (s.n * s.q3 + {WEIGHT} * ((l.n * l.q3 + {WEIGHT} * c.q3) // (l.n + {WEIGHT}))) // (s.n + {WEIGHT}) AS q3
  FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.metric = l.metric JOIN c ON c.metric = s.metric
), f AS (
  SELECT lang, source, {_fences} FROM q GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({within_sql().replace(" div ", " // ")}, false) AS kept
FROM counts c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""
QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": ORACLE}
