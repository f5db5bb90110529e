"""The prefix trie against plain dictionaries: deep and wide conversations, hot nodes, missing openings."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm import trie  # noqa: E402
from siglake.llm.registry import QUERIES  # noqa: E402


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    ids, parent, depth, text = {(): 0}, {0: None}, {0: 0}, {0: ""}  # nodes by number, as sequences would be held whole
    step = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        node = 0
        members[0].append(c)
        for turn in own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]:  # remainders as in SQL
            if (node, turn) not in step:
                new = step[node, turn] = len(parent)
                parent[new], depth[new], text[new] = node, depth[node] + 1, turn[1]
                kids[node].add(new)
            node = step[node, turn]
            members[node].append(c)
        ends[node].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in sorted(parent, key=lambda n: -depth[n]):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * len(text[n])
        if parent[n] is not None:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    return sorted(
        (min(m), depth[n], -1 if parent[n] is None else min(members[parent[n]]), len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")


def found(spark, tmp_path):
    out = QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for c in [100 * k + j for k in range(-2, 5) for j in rng.sample(range(100), 40) + [0] * (k % 2)]:
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "é", None])) for t in range(rng.choice([1, 2, 3, 9, 30]))]
    table(spark, tmp_path, rows)
    assert found(spark, tmp_path) == brute(rows)


def test_deep_and_shared(spark, tmp_path):
    """Two conversations of 9,000 turns that part at 5,000, beside short ones: pieces of 4096 turns, 14 rounds."""
    rows = [(c, t, "user", f"t{t if t < 5000 else t + c}") for c in (100, 200) for t in range(9000)] + [(c, 0, "user", "t0") for c in range(300, 320)]
    table(spark, tmp_path, rows)
    assert found(spark, tmp_path) == brute(rows)


def test_many_ends(spark, tmp_path):
    """One node where more conversations end than one list of ids holds."""
    rows = [(c, 0, "user", "same") for c in range(2 * trie.PIECE + 50)] + [(c, 1, "bot", str(c)) for c in range(0, 500, 7)]
    table(spark, tmp_path, rows)
    assert found(spark, tmp_path) == brute(rows)
