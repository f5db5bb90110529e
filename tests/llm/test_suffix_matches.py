"""Longest matches against a plain search over all pairs of places, in one block and in many, in one shard and in many."""

import random

import numpy as np
import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.decontaminate import Block, find_matches  # noqa: E402


def plain(doc: list, item: list, window: int) -> set:
    need, found = min(window, len(item)), set()
    for p in range(len(doc)):
        for i in range(len(item)):
            n = 0
            while p + n < len(doc) and i + n < len(item) and doc[p + n] == item[i + n]:
                n += 1
            if n and n >= need and not (p and i and doc[p - 1] == item[i - 1]):
                found.add((p, n, i))
    return found


@pytest.mark.parametrize("words", [2, 3, 12])
def test_longest_matches(words):
    draw = random.Random(words)
    make = lambda n: [b"w%d" % draw.randrange(words) for _ in range(n)]
    items = [(str(k), make(n)) for k, n in enumerate((1, 2, 3, 4, 7, 16, 31, 40))]
    docs = [make(n) for n in (0, 1, 3, 30, 80)] + [[b"unknown"] * 3 + items[7][1] + [b"unknown"] + items[3][1], items[6][1][5:] + items[7][1][:9]]
    Block.PAIRS, kept = 50, Block.PAIRS
    try:
        block = Block(items + items[:2], 4)
        found = block.search([np.array([block.vocab.get(w, 0) for w in d], dtype=np.uint32) for d in docs])
    finally:
        Block.PAIRS = kept
    for doc, hits in zip(docs, found):
        assert sorted(hits) == sorted((p, n, item, i) for item, text in items for p, n, i in plain(doc, text, 4))


def test_blocks_and_shards_change_nothing(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda **o: sorted((r.doc_id, sorted((h.start, h.n, h.item_id, h.item_start) for h in r.hits)) for r in find_matches(docs, items, **o).collect())
    once = rows()
    assert any(h for _, h in once) and once == rows(block_words=300) == rows(shard_words=100)
