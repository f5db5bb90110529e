"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries weights. Token capacities
(tokens times ``max_epochs``) add up from the leaves; the budget then flows
down: the children of a node share its budget by weight, a child takes no more
than its capacity, and what it can't take goes to its siblings. As a node never
gets more than its subtree can hold, a shortage leaves a subtree only when all
siblings below are full. All amounts are integers (products in decimals), so
the result is the same on any cluster.

Each leaf then takes whole epochs and a token-prefix of one more epoch in the
order of a seeded hash. The prefix is cut without sorting a leaf in one task:
tokens are summed in 4,096 ranges of the hash, the range that holds the cut is
found from those sums, and only its documents (a 4,096th of the leaf) are
ranked. The cut is kept as a hash value per leaf, so the selection is a filter.

Edge cases. Null text: no tokens, never drawn by a prefix with tokens in it but
free to take. Null domain, lang or source: an empty name in the
tree; lang and source pass through as they are. Repeated
documents share their hash and are taken or left together. Empty table: no
rows. Extra columns pass through unless they bear a name the operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import checked_broadcast, materialize

TOKENS = r"regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+')"
LEVELS = ("domain", "lang", "source")
ADDED = ("domain", "n_tokens", "copies")


def weight_sql(column: str, weights: dict[str, int]) -> str:
    """Integer weights by name; others weigh 1."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {column} {cases} ELSE 1 END" if cases else "1"


#: Runs in Spark and in DuckDB. caps: domain, lang, source, tokens. One level shares out what the level above got.
LEVEL = """
  SELECT *, CASE WHEN full_ THEN cap ELSE
      CAST(FLOOR(CAST((budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent})) * w AS DECIMAL(38, 0)) {div} (sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent}))) AS BIGINT) END AS got
  FROM (
    SELECT *, CAST(cap AS DECIMAL(38, 0)) * (sum(w) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) DESC, {name} DESC ROWS UNBOUNDED PRECEDING))
      <= CAST(budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38, 0)) * w AS full_
    FROM ({below})
  )
"""


def budget_sql(caps: str, weights: dict[str, dict[str, int]], share: float, div: str = "div") -> str:
    """SQL of domain, lang, source, tokens, got for every leaf."""
    permille = round(1000 * share)
    root = f"SELECT domain, {weight_sql('domain', weights.get('domain', {}))} AS w, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS BIGINT) {div} 1000 * {permille} FROM {caps}) AS budget FROM {caps} GROUP BY domain"
    lang = f"SELECT c.domain, c.lang, {weight_sql('c.lang', weights.get('lang', {}))} AS w, CAST(sum(c.cap) AS BIGINT) AS cap, max(p.got) AS budget FROM {caps} c JOIN by_domain p ON c.domain = p.domain GROUP BY c.domain, c.lang"
    leaf = f"SELECT c.domain, c.lang, c.source, {weight_sql('c.source', weights.get('source', {}))} AS w, c.cap, c.tokens, p.got AS budget FROM {caps} c JOIN by_lang p ON c.domain = p.domain AND c.lang = p.lang"
    return (
        f"WITH by_domain AS ({LEVEL.format(parent='1', name='domain', below=root, div=div)}),"
        f" by_lang AS ({LEVEL.format(parent='domain', name='lang', below=lang, div=div)}),"
        f" by_leaf AS ({LEVEL.format(parent='domain, lang', name='source', below=leaf, div=div)})"
        " SELECT domain, lang, source, tokens, got FROM by_leaf"
    )


def leaf_cuts(stats: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """For every leaf its whole epochs and the last hash of the prefix. stats: domain, lang, source, n_tokens, key."""
    spark = stats.sparkSession
    leaf = list(LEVELS)
    bins = materialize(stats.groupBy(*leaf, F.substring("key", 1, 3).alias("bin")).agg(F.sum("n_tokens").alias("n")), "bins")
    caps = bins.groupBy(*leaf).agg(F.sum("n").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    got = materialize(spark.sql(budget_sql("{caps}", weights, share), caps=materialize(caps, "caps")), "budget")
    got = got.select(*leaf, F.expr("CASE WHEN tokens > 0 THEN got div tokens ELSE 0 END").alias("epochs"), F.expr("CASE WHEN tokens > 0 THEN got % tokens ELSE 0 END").alias("rest"))
    # the first range with which the sum exceeds the rest holds the cut
    upto = spark.sql("SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY bin) AS upto FROM {bins}", bins=bins)
    at = got.join(upto, leaf, "left").where("upto > rest or n is null").groupBy(*leaf, "epochs", "rest").agg(F.min_by("bin", "upto").alias("bin"), F.min_by(F.expr("upto - n"), "upto").alias("before"))
    at = materialize(got.join(at.select(*leaf, "bin", "before"), leaf, "left"), "cut_bins")
    held = stats.withColumn("bin", F.substring("key", 1, 3)).join(checked_broadcast(at), [*leaf, "bin"]).groupBy(*leaf, "key").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    ranked = spark.sql("SELECT *, before + sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM {held}", held=held)
    last = ranked.where("upto <= rest").groupBy(*leaf).agg(F.max("key").alias("last_key"))
    # a leaf whose cut lies before its first document in the range still takes all ranges before
    return at.join(last, leaf, "left").select(*leaf, "epochs", F.when(F.col("bin").isNull(), F.lit("g")).otherwise(F.coalesce("last_key", "bin")).alias("last_key"), "rest")


def mix(documents: DataFrame, domain: Column, weights: dict[str, dict[str, int]], *, share: float = 0.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The documents that are drawn, with domain, n_tokens and copies (how often each is drawn)."""
    tree = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    node = [F.coalesce(tree[c], F.lit("")).alias(c) for c in LEVELS]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    stats = materialize(documents.select(*node, F.expr(TOKENS).cast("bigint").alias("n_tokens"), key.alias("key")), "tokens")
    cuts = checked_broadcast(materialize(leaf_cuts(stats, weights, share, max_epochs), "cuts"))
    plain = [c for c in documents.columns if c not in ADDED]
    drawn = documents.select(*plain, *[n.alias(f"_{c}") for n, c in zip(node, LEVELS)], key.alias("_key"))
    cuts = cuts.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("epochs").alias("_epochs"), F.col("last_key").alias("_last"), F.col("rest").alias("_rest"))
    drawn = drawn.join(cuts, [f"_{c}" for c in LEVELS]).withColumn("copies", F.expr("_epochs + CASE WHEN _rest > 0 AND _key <= _last THEN 1 ELSE 0 END")).where("copies > 0")
    return drawn.select(*plain, F.col("_domain").alias("domain"), F.expr(TOKENS).cast("bigint").alias("n_tokens"), F.col("copies").cast("bigint").alias("copies"))
