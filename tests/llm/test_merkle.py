"""The Merkle manifest: traversal against a plain tree, several blocks, ties, nulls, many languages."""

import hashlib
import random

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.merkle import ARITY, LEVELS, TreeHash, successive_paths  # noqa: E402
from siglake.llm.registry import ORACLES, QUERIES  # noqa: E402
from tests.oracle import assert_same  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, key int, g string"


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][k : k + ARITY]).encode()).hexdigest() for k in range(0, len(levels[-1]), ARITY)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 512, 513, 600, 4000, 4096])
def test_traversal(n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    levels = plain_tree(leaves)
    height = len(levels) - 1
    tree = TreeHash(height)
    for x in leaves:
        tree.push(x)
    assert tree.close().node == levels[-1][0]
    for k, (before, after) in enumerate(successive_paths(leaves, height)):
        for level in range(height):
            at = k // ARITY**level
            run = at - at % ARITY
            assert before[level] == "".join(levels[level][run:at]) and after[level] == "".join(levels[level][at + 1 : run + ARITY])
    assert k == n - 1


def test_traversal_keeps_few_nodes():
    """Besides its leaves a block's walk holds two subtrees a layer and an open run a level."""
    held = []

    t = TreeHash(LEVELS, range(2, LEVELS))
    for k in range(ARITY**LEVELS):
        t.push(str(k))
        held.append(sum(map(len, t.open)) + sum(map(len, t.kept.values())))
    assert max(held) <= ARITY * LEVELS + ARITY**2 + ARITY + 1


@pytest.mark.parametrize("case", ["blocks", "odd", "one", "languages"])
def test_against_sql(spark, tmp_path, case):
    random.seed(5)
    if case == "blocks":  # two blocks of the one language, few rows of the other
        rows = [(k, f"Text {k}", "en" if k % 50 else "de", "s", k) for k in random.sample(range(10_000), 4300)]
    elif case == "odd":
        rows = [(None, None, None, None, None), (None, "", "", "", 0), (3, "É a\tB", "en", None, 3), (3, "É a\tB", "en", None, 3), (3, "other", "en", "s", 3), (-4, "neg", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", None, "s", 1), (8, None, "=en", "s", 1)]
    elif case == "one":
        rows = [(3, "Only", "en", "s", 4)]
    else:
        rows = [(k, f"T{k}", f"l{k % 75}" if k % 75 else None, "s", k) for k in range(300)]
    spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(QUERIES["op12_merkle_manifest"](spark, str(tmp_path)), str(tmp_path), ORACLES["op12_merkle_manifest"])


def test_tampering_shows(spark, sf):
    out = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out:
        t = texts[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and t is not None and any("A" <= c <= "Z" for c in t)
        assert r.verified == (not changed)
