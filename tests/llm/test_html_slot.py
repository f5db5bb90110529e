"""The article's slot keeps its text whatever its classes are called; long, deep and broken pages take linear time and memory."""

import time
import tracemalloc

import pytest

pytest.importorskip("siglake.llm")
from siglake.llm.html import extract_text, page_blocks  # noqa: E402


def texts(page, **options):
    return [t for _, t in page_blocks(page, **options)[0]]


def test_class_words_tell_nothing_in_an_article():
    page = (
        "<body><div class='banner'>out</div><article><p class='notice'>one</p><p class='banner'>two</p><div class='related'>three</div><section class='search'>four</section>"
        "<table class='menu'><tr><td>five</table><p>six <span class='label-promo'>seven</span> <span class='ad'>eight</span></p><div class='comment-on-law'>nine</div><div class='content ad'>ten</div>"
        "<div class='comments'>no</div><div class='ad-slot'>no</div><section id='comment-list'>no</section><form>no</form><aside>no</aside><nav>no</nav></article></body>"
    )
    assert texts(page) == ["one", "two", "three", "four", "five", "six seven eight", "nine", "ten"]


PAGE = "<body><div class='menu'>Go</div><div class='k'><h1>T{0}</h1><p>The words of page {0} come here and are a few more.</p><div class='related'>Own part {0}, long enough to count.</div><p class='notice'>Mind {0}.</p><div class='comments'>Nice {0}!</div></div><div class='z'>End of all pages here.</div><div class='z2'>Once more, the end.</div></body>"


def test_class_words_tell_nothing_in_a_slot(spark):
    pages = [(i, f"http://a.org/{i}", PAGE.format(i) + "<!-- {0} -->") for i in range(12)]
    out = extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(out) == 12 and all(r.text == f"T{r.page_id}\nThe words of page {r.page_id} come here and are a few more.\nOwn part {r.page_id}, long enough to count.\nMind {r.page_id}." for r in out)


N = 100_000
LONG = {
    "nested": "<div>x" * N + "</div>" * N,
    "unclosed": "<div>x" * N,
    "unclosed words": "<x-y>x" * N,
    "open tags": "<a " * N + "text",
    "open scripts": "<script " * N + "text",
    "quotes": "<a \"'" * N + "text",
    "comments": "<!-" * N + "text",
    "ends": "<div>" * 8000 + "</b></x></p></span>" * 25_000 + "text",
    "crossed": "<p><div>" * (N // 2) + "</p></div>" * (N // 2) + "text",
    "items": "<ul><li>x" * (N // 2),
    "text": "word &amp; " * N,
    "attributes": "<p class='" + "x " * N + "'>text",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_pages(name):
    tracemalloc.start()
    began = time.time()
    blocks = page_blocks("<body><article><p>first</p></article>" + LONG[name])[0]
    took, most = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert blocks[0][1] == "first" and took < 20 and most < 500e6, (took, most)


def test_deep_pages_of_one_host(spark):
    """The template of a host of deep pages: sums over 3,000 levels by doubling."""
    deep = "<div>a{0} x" * 3000
    pages = [(i, f"http://deep.org/{i}", f"<body><p>Text {i}.</p>" + deep.format(i)) for i in range(4)]
    out = extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in out:  # the innermost place that keeps nine tenths of the text
        kept = r.text.split("\n")
        assert len(kept) >= 2700 and set(kept) <= {f"a{r.page_id} x", f"Text {r.page_id}."}
