"""Fences of op1 against a plain version; no switch at any number of documents."""

import math
from collections import defaultdict

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.rules import METRICS, fences  # noqa: E402

COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_capitals".split()


def values(r):
    return {
        "word_length": 100 * r["word_chars"] // r["n_words"], "symbols": 10000 * r["n_symbols"] // r["word_chars"], "dup_lines": 10000 * r["n_dup_lines"] // r["n_words"],
        "repeats": 10000 * r["n_repeat_words"] // r["n_words"], "capitals": 10000 * r["n_capitals"] // r["word_chars"],
    }


def quartile(v, part):
    return sorted(v)[math.ceil(part * len(v) / 4) - 1]


def plain(rows, weight):
    """The fences of every language and source, from the values themselves."""
    by = defaultdict(list)
    for r in rows:
        for m, v in values(r).items():
            k = max(v.bit_length() - 7, 0)
            for key in ((r["lang"], r["source"], m), (r["lang"], m), (m,)):
                by[key].append(v >> k << k)
    out = {}
    for lang, source in {(r["lang"], r["source"]) for r in rows}:
        for m, (_, slack, both) in METRICS.items():
            s, of_lang, c = by[lang, source, m], by[lang, m], by[(m,)]
            q1, q3 = ((len(s) * quartile(s, p) + weight * ((len(of_lang) * quartile(of_lang, p) + weight * quartile(c, p)) // (len(of_lang) + weight))) // (len(s) + weight) for p in (1, 3))
            out[lang, source, m] = (q1 - 3 * (q3 - q1) - slack if both else -1, q3 + 3 * (q3 - q1) + slack)
    return out


@pytest.mark.parametrize("weight", [1, 100])
def test_fences(spark, weight):
    rows = []
    for k in range(700):
        n = 20 + k * 37 % 900
        rows.append(dict(zip(COLUMNS, (k, n, n * (3 + k % 5) + k % 7, k * 13 % 40, k % 11 % 4, k * 7 % 30, k * 3 % 50)), lang=["en", "en", "de", None][k % 4], source=[None, "a", "b"][0 if k == 5 else 1 + (k % 100 > 3)]))
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", lang string, source string"
    want = plain(rows, weight)
    got = fences(spark.createDataFrame(rows, schema), weight).collect()
    assert len(got) == len({k[:2] for k in want})
    for r in got:
        for m in METRICS:
            assert (r[f"lo_{m}"], r[f"hi_{m}"]) == want[r.lang, r.source, m]


def test_no_switch(spark):
    """The fences move little by little with the number of documents of a source, from its language's to its own."""
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", lang string, source string"

    def high(n):
        make = lambda k, chars, source: (k, 100, chars, 0, 0, 0, 0, "en", source)
        rows = [make(k, 400 + k % 100, "big") for k in range(5000)] + [make(9000 + k, 1200, "small") for k in range(n)]
        return next(r.hi_word_length for r in fences(spark.createDataFrame(rows, schema), 100).collect() if r.source == "small")

    found = {n: high(n) for n in (1, 98, 99, 100, 101, 4000)}
    assert abs(found[99] - found[98]) < 12 and abs(found[100] - found[99]) < 12 and abs(found[101] - found[100]) < 12
    assert found[1] < found[99] < found[101] < found[4000] and found[1] < 950 and found[4000] > 1200
