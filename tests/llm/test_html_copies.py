"""Hosts whose pages share their article in op3_html_text."""

import pytest

pytest.importorskip("siglake.llm")
from siglake.llm.html import extract_text  # noqa: E402


@pytest.mark.parametrize("n", [19, 20])
def test_copies_and_shared_paragraphs_keep_their_text(spark, n):
    page = "<html><body><nav>menu</nav><article><p>{}</p><p>Shared by all.</p></article></body></html>"
    rows = [(i, u, page.format(t)) for i in range(n) for u, t in ((f"http://same.org/{i}", "One text."), (f"http://own.org/{i}", f"Text {i}."), (None, "No host."))]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        first = "No host." if r.url is None else "One text." if "same" in r.url else f"Text {r.page_id}."
        assert r.text == f"{first}\nShared by all."
    assert len(out) == 3 * n
