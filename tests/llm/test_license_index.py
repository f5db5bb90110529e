"""The licence index: whole texts, texts cut at a mandatory phrase, and very many places in one text."""

import time

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.licenses import TEMPLATES, index, scan_licenses  # noqa: E402
from siglake.llm.licenses_queries import ORACLE  # noqa: E402
from tests.oracle import assert_same  # noqa: E402


def test_anchors_are_mandatory_and_rarest():
    entries = index()
    df = {w: sum(w in t.words for t in entries) for t in entries for w in t.words}
    for t in entries:
        assert max(df[w] for w, _ in t.anchors) <= sorted(df[t.words[p]] for p in t.must)[len(t.anchors) - 1]
        assert all(t.words[p] == w and p in t.must for w, p in t.anchors)


def test_every_text_and_every_break(spark, tmp_path):
    rows = []
    for (label, text, _), t in zip(TEMPLATES, index()):
        rows.append(f"head words\n{text.upper()} tail")
        for p in {t.must[0], t.must[-1], t.anchors[0][1]}:  # one mandatory word is another, one is left out, one is added before it
            rows += [" ".join(t.words[:p] + middle + t.words[p + 1 :]) for middle in (["zzz"], [], ["zzz", t.words[p]])]
    rows.append(" ".join(text for _, text, _ in TEMPLATES))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = scan_licenses(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert_same(out, str(tmp_path), ORACLE)
    whole = {r.doc_id: r for r in out.collect()}
    assert all(whole[k].score == 1.0 for k, text in enumerate(rows) if text.startswith("head words"))
    assert set(whole[len(rows) - 1].labels.split(",")) >= {label for label, _, _ in TEMPLATES}


def test_many_places_in_one_text(spark):
    text = "released under the mit license all rights reserved this program is free software gnu general public license version 3 " * 20_000
    started = time.monotonic()
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_base == 40_000 and row.labels == "gpl,gpl-3.0,mit,reserved" and time.monotonic() - started < 60
