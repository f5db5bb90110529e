"""Quality rules with thresholds that come from the corpus itself.

Every document gets five integer ratios. Their distributions are kept as
mergeable quantile sketches: counts of values cut to their ``SKETCH_BITS``
leading bits, a relative error under 1/64, so that two sketches merge by adding
counts and the result does not depend on the order of merging. The sketches of
a language's sources add up to the sketch of the language, and those to that of
the corpus. Per language and source, quartiles give outlier fences. A source's
quartiles are drawn to those of its language with the weight of ``weight``
documents, and a language's to those of the corpus in the same way, so that a
few documents decide little and many decide all but nothing is switched between.
A join of documents and fences filters.

The text is read once: the per-document counts (some 80 bytes) are written to
the shared folder, and both the sketch and the filter read them there.

Edge cases. Long texts: read whole; a text's words and windows are held once.
Ties: equal values count alike, so nothing depends on an order. Null or empty
text: no words, base_failed. Null lang or source: a
group of its own. Repeated documents: a row each. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import WORD_GAP, checked_broadcast, materialize, words_sql

SKETCH_BITS = 7
#: metric: (SQL over the counts, slack that is always allowed, whether a low value is as bad as a high one)
METRICS = {
    "word_length": ("100 * word_chars div nullif(n_words, 0)", 100, True),
    "symbols": ("10000 * n_symbols div nullif(word_chars, 0)", 100, False),
    "dup_lines": ("10000 * n_dup_lines div nullif(n_words, 0)", 200, False),
    "repeats": ("10000 * n_repeat_words div nullif(n_words, 0)", 1000, False),
    "capitals": ("10000 * n_capitals div nullif(word_chars, 0)", 1000, False),
}


def sketch_value(v: str, left: str = "shiftleft", right: str = "shiftright") -> str:
    """SQL: v with all but its SKETCH_BITS leading bits cleared."""
    cut = f"greatest(length(bin({v})) - {SKETCH_BITS}, 0)"
    return f"{left}({right}({v}, {cut}), {cut})"


def document_counts(documents: DataFrame) -> DataFrame:
    """The base counts per document. Windows of three words are told apart by a 64-bit hash within one document."""
    d = documents.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.expr(words_sql("text", WORD_GAP)).alias("words"))
    d = d.select("*", F.expr("CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) ELSE array(0L) END").alias("tri"))
    # only texts with a repeated window need the places in order of the hash
    d = d.select("*", F.expr("CASE WHEN size(array_distinct(tri)) < size(tri) THEN array_sort(transform(tri, (h, i) -> struct(h, i))) END").alias("by_hash"))
    lines = r"filter(split(text, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
    d = d.select("*", F.expr(lines).alias("lines"))
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.expr("length(text) - length(regexp_replace(text, '[#*$%&|<>]', ''))").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(
            "coalesce(aggregate(array_sort(transform(filter(sequence(0, size(by_hash) - 1), k -> coalesce(get(by_hash, k).h = get(by_hash, k - 1).h, false) or coalesce(get(by_hash, k).h = get(by_hash, k + 1).h, false)), k -> get(by_hash, k).i)),"
            " struct(0 as e, 0L as n), (a, p) -> struct(p + 3 as e, a.n + p + 3 - greatest(a.e, p) as n), a -> a.n), 0L)"
        ).alias("n_repeat_words"),
        F.expr("length(text) - length(regexp_replace(text, '[A-ZÀ-Þ]', ''))").cast("bigint").alias("n_capitals"),
    )


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, n (documents), q1 and q3 of the sketches merged by keys: the least values with a quarter and three quarters of the documents up to them."""
    merged = sketch.groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    d = merged.select(*keys, "metric", "v", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("total"))
    least = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("v")))
    return d.groupBy(*keys, "metric").agg(F.max("total").alias("n"), least(1).alias("q1"), least(3).alias("q3"))


def fences(counts: DataFrame, weight: int) -> DataFrame:
    """lang, source, and for each metric lo_ and hi_, from the merged sketches."""
    stacked = ", ".join(f"'{m}', {sql}" for m, (sql, _, _) in METRICS.items())
    sketch = (
        counts.where("n_words > 0")
        .selectExpr("lang", "source", f"stack({len(METRICS)}, {stacked}) as (metric, v)")
        .selectExpr("lang", "source", "metric", f"{sketch_value('v')} as v")
        .groupBy("lang", "source", "metric", "v")
        .agg(F.count("*").alias("n"))
    )
    sketch = materialize(sketch, "sketch")
    renamed = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    own, lang, all_ = quartiles(sketch, "lang", "source"), renamed(quartiles(sketch, "lang"), "l"), renamed(quartiles(sketch), "c")
    d = own.join(lang, own.lang.eqNullSafe(F.col("l_lang")) & (own.metric == F.col("l_metric"))).join(F.broadcast(all_), F.col("metric") == F.col("c_metric"))  # a row per metric
    drawn = lambda q: F.expr(f"(n * {q} + {weight} * ((l_n * l_{q} + {weight} * c_{q}) div (l_n + {weight}))) div (n + {weight})").alias(q)
    d = d.select("lang", "source", "metric", drawn("q1"), drawn("q3"))
    sides = []
    for m, (_, slack, both) in METRICS.items():
        of = lambda e, m=m: F.max(F.when(F.col("metric") == m, F.expr(e)))
        sides += [of(f"q3 + 3 * (q3 - q1) + {slack}").alias(f"hi_{m}"), of(f"q1 - 3 * (q3 - q1) - {slack}" if both else "-1").alias(f"lo_{m}")]
    return d.groupBy("lang", "source").agg(*sides)


def within_sql() -> str:
    return " and ".join(f"{sql} between lo_{m} and hi_{m}" for m, (sql, _, _) in METRICS.items())


def quality_rules(documents: DataFrame, *, weight: int = 100) -> DataFrame:
    """Counts, base verdict and the adaptive verdict of every document."""
    counts = materialize(document_counts(documents), "counts")
    f = checked_broadcast(materialize(fences(counts, weight), "fences"))
    f = f.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[c for c in f.columns if c[:3] in ("lo_", "hi_")])
    joined = counts.join(f, counts.lang.eqNullSafe(f.f_lang) & counts.source.eqNullSafe(f.f_source), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.expr(f"coalesce(n_words > 0 and {within_sql()}, false)")).alias("kept")
    )

