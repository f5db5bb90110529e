"""Queries without SQL against brute-force versions, accuracy on labels, or what must hold of their results."""

import html
import re
from collections import defaultdict

import pytest

pytest.importorskip("siglake.llm.registry")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from siglake.llm.classifier import score  # noqa: E402
from siglake.llm.html import page_blocks  # noqa: E402
from siglake.llm.pii import feistel, luhn_sum, pseudonymize  # noqa: E402
from siglake.llm.registry import QUERIES  # noqa: E402


def luhn(d: str) -> bool:
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    d = spark.range(27 * 50).selectExpr(f"{feistel('k', 'date', 'id div 50', 'id % 50', '27', '50')} as f").selectExpr("f.l * 50 + f.r as y")
    assert sorted(r.y for r in d.collect()) == list(range(27 * 50))


def test_luhn_sum(spark):
    for d in ("4539578763621486", "79927398713", "79927398710"):
        assert (spark.range(1).selectExpr(f"{luhn_sum(repr(d), 1)} as s").first().s % 10 == 0) == luhn(d)


def test_pii_keeps_formats_and_links(spark):
    texts = ["card 4539 5787 6362 1486 or 4539578763621486.", "no card 4539578763621487", "born 2001-02-29 or 2004-02-29, 31/12/1999", "mail bob.x@mail.example.com ip 10.0.0.300 and 10.0.0.30", "+1 (743) 555-3824 and 123-45-6789, 000-45-6789", "DE89 3704 0044 0532 0130 00", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonymize(rows, key="k").collect()}
    one, two = re.findall(r"[\d ]{16,}\d", out[0].text)
    assert one.replace(" ", "").strip() == two.strip() != "4539578763621486" and luhn(two.strip()) and re.search(r"\d{4} \d{4} \d{4} \d{4}", out[0].text)
    assert out[1].text == texts[1]
    assert "2001-02-29" in out[2].text and "2004-02-29" not in out[2].text and out[2].n_date == 2
    assert "bob" not in out[3].text and "10.0.0.300" in out[3].text and out[3].n_ip == 1 and out[3].n_email == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{2}-\d{4}, 000-45-6789", out[4].text) and "555-3824" not in out[4].text
    d = re.sub(r"\D", "", out[5].text)
    assert out[5].n_iban == 1 and int(d[2:] + "1314" + d[:2]) % 97 == 1
    assert out[6].text is None and out[7].text == ""


def test_html_against_plain_regex(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_noise_and_unclosed_elements():
    page = '<body><aside>x</aside><div id="content"><p>one <span class="ad">buy</span>two<p>three<ul><li>i<li>ii</ul><div class="comments">no</div><script>"</p>"</script>tail</div>'
    assert [t for _, t in page_blocks(page)[0]] == ["one two", "three", "i", "ii", "tail"]


def test_every_verbatim_passage_is_found(spark, sf):
    at = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = r.text.lower().encode().split()
        for k in range(len(w) - 49):
            at[tuple(w[k : k + 50])].add((r.doc_id, k))
    found = {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.spans.split(",")] for r in QUERIES["op4_substring_dedup"](spark, sf).collect()}
    for places in at.values():
        if len({d for d, _ in places}) > 1:
            for d, k in places:
                assert any(a <= k and k + 50 <= b for a, b in found[d])


def test_classifier_on_labels_it_has_not_seen(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = score(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    clean = F.expr("quality = 1 and toxic = 0")
    r = out.agg(F.avg(F.when(clean, F.col("kept").cast("int"))).alias("kept"), F.avg(F.when(~clean, 1 - F.col("kept").cast("int"))).alias("caught")).first()
    assert r.kept >= 0.97 and r.caught >= 0.7


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_words", F.lit("kept as it is")).withColumn("rest", F.lit(1))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else out.cache()
        assert 0 < docs.count() and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        assert {r.n_words for r in docs.collect()} == {"kept as it is"}
