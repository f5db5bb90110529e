"""Template deduction in op3_html_text where no tag or class tells what is article."""

import pytest

pytest.importorskip("siglake.llm")
from siglake.llm.html import extract_text, page_tokens, template_texts  # noqa: E402

PAGE = (
    "<html><body><div class='a1'><div class='a2'>Home</div><div class='a2'>World</div></div><div class='b7'><h1>Title {0}</h1><div class='t'>"
    + "<p>Sentence {0} of this page, which no other page of its host has.</p>" * 4
    + "<p>Shared by all pages.</p></div></div><div class='z9'><p>All rights kept by the owner of this host.</p></div></body></html>"
)


def html_rows(n):
    return [(i, f"http://plain.org/{i}", PAGE.format(i)) for i in range(n)]


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("n", [3, 40])
def test_template_alone_removes_unlabelled_chrome(spark, n, labelled):
    out = extract_text(spark.createDataFrame(html_rows(n), "page_id long, url string, html string"), labelled=labelled).collect()
    assert len(out) == n
    for r in out:
        assert r.text.split("\n") == [f"Title {r.page_id}"] + [f"Sentence {r.page_id} of this page, which no other page of its host has."] * 4 + ["Shared by all pages."]


def test_word_lists_off_on_the_test_pages(spark, sf):
    """Menus recur with the template, so they must go without any list; adverts and footers differ from page to page there, so only the lists know them."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    on = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in extract_text(pages, labelled=False).collect():
        assert on[r.page_id] in r.text and len(html) == len(on)


def test_classes_against_brute_force(spark):
    rows = html_rows(5) + [(9, "http://other.org/", PAGE.format(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "split(url, '/')[2] as host")
    found = template_texts(page_tokens(pages, labelled=False)).collect()
    # Home, World, the shared paragraph and the notice stand on all five pages of plain.org, once each
    assert len(found) == 4 and all(r.host == "plain.org" and r.pages == r.total == 5 for r in found)


def test_headings_outside_the_longest_part_stay(spark):
    page = "<body><div class='x'><h1>T{0}</h1><div class='y'><p>" + "Long text number {0}. " * 200 + "</p></div></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(4)] + [(7, "http://e.org", None), (8, None, "")]
    out = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].text.startswith(f"T{i}\nLong text") for i in range(4))
    assert (out[7].text, out[7].n_chars, out[8].text) == ("", 0, "")


def test_empty_table(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
