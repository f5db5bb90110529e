"""Query op6_mixing and its DuckDB SQL."""

from pyspark.sql import functions as F

from siglake.llm.common import read
from siglake.llm.mixing import budget_sql, mix

#: The tables name no domain; it follows from the source's number, as a crawl's seed list would say.
DOMAIN = "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'wiki' ELSE 'code' END"
WEIGHTS = {"domain": {"web": 4, "books": 3, "wiki": 2, "code": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
SHARE, EPOCHS, SEED = 0.5, 2, "mix"


def domain():
    return F.expr(DOMAIN.replace("CAST(substr(source, 4) AS INT)", "try_cast(substr(source, 4) AS INT)"))


def op6_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"), domain(), WEIGHTS, share=SHARE, max_epochs=EPOCHS, seed=SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


#: Over a table docs with doc_id, lang, source and text.
def mix_sql(docs: str) -> str:
    return rf"""
stats AS (
  SELECT doc_id, lang AS own_lang, source AS own_source, coalesce({DOMAIN}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}
), caps AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS cap FROM stats GROUP BY ALL
), got AS ({budget_sql("caps", WEIGHTS, SHARE, "//")}
), ranked AS (
  SELECT s.*, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN got % tokens ELSE 0 END AS rest, sum(n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source ORDER BY key) AS upto
  FROM stats s JOIN got g ON s.domain = g.domain AND s.lang = g.lang AND s.source = g.source
), drawn AS (
  SELECT doc_id, domain, own_lang AS lang, own_source AS source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked
)"""


QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": f"WITH {mix_sql('documents')} SELECT * FROM drawn WHERE copies > 0"}
