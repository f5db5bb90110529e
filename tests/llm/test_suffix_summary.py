"""Spans and items per document against the list of all matches; stems that thousands of items share."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.decontaminate import Block, decontaminate  # noqa: E402


def numbers(block, docs):
    return [np.array([block.vocab.get(w, 0) for w in d], dtype=np.uint32) for d in docs]


@pytest.mark.parametrize("words", [2, 3, 12])
@pytest.mark.parametrize("window", [1, 4, 6])
def test_summary_is_that_of_all_matches(words, window):
    draw = random.Random(words * 10 + window)
    make = lambda n: [b"w%d" % draw.randrange(words) for _ in range(n)]
    items = [(None if k == 3 else str(k), make(n)) for k, n in enumerate((1, 2, 3, 4, 7, 16, 31, 40))]
    items += [("9", items[6][1][:9]), ("10", items[7][1]), ("7", items[5][1])]
    docs = [make(n) for n in (0, 1, 3, 30, 80)] + [[b"unknown"] * 3 + items[7][1] + [b"unknown"] + items[3][1], items[6][1][5:] + items[7][1][:9]]
    block = Block(items, window)
    for found, (spans, own) in zip(block.search(numbers(block, docs)), block.summary(numbers(block, docs))):
        whole = {(p, n) for p, n, _, _ in found}
        assert set(spans) <= whole and len(spans) == len(set(spans))
        assert {x for p, n in spans for x in range(p, p + n)} == {x for p, n in whole for x in range(p, p + n)}
        assert max((n for _, n in spans), default=0) == max((n for _, n in whole), default=0)
        assert own == sorted({i for _, _, i, _ in found} - {None})


def test_ten_thousand_items_of_one_stem(spark):
    stem = " ".join(f"s{k}" for k in range(40))
    bench = spark.createDataFrame([(k, f"{stem} own{k}") for k in range(10_000)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"a b {stem} c {stem} own{k} z" * (1 + k % 3)) for k in range(200)] + [(999, "none of it")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in decontaminate(docs, bench, window=10).drop("items").collect()}
    assert time.time() - began < 100
    assert all(rows[k].n_items == 10_000 and rows[k].longest_match == 41 for k in range(200)) and not rows[999].contaminated
