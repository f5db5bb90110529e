"""Places by a distributed sort, and joins with hot keys, against plain versions."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("siglake.llm")
from pyspark.sql import functions as F  # noqa: E402
from siglake.llm.common import hot_join, numbered  # noqa: E402
from siglake.llm.trie import hot_keys, rolled_up  # noqa: E402


def test_places_in_groups_of_any_size(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.6 else random.choice(["a", "b", None]), random.choice([None, *range(50)]), k) for k in range(4000)]
    out = numbered(spark.createDataFrame(rows, "g string, o long, k long").repartition(7), ["g"], ["o", "k"], "test")
    assert out.select("k").distinct().count() == 4000
    by = defaultdict(list)
    for r in out.collect():
        by[r.g].append((r.i, r.o is not None, r.o or 0, r.k))
    for g, found in by.items():
        found.sort()
        assert [i for i, *_ in found] == list(range(len(found))) and [x[1:] for x in found] == sorted(x[1:] for x in found), g


def test_places_of_nothing(spark):
    assert numbered(spark.createDataFrame([], "g string, o long"), ["g"], ["o"], "test").collect() == []


def test_join_with_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(-1, 4500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k", "n")
    assert [r.k for r in hot.collect()] == [-1]
    out = hot_join(left, right, "k", hot)
    assert sorted((r.id, r.v) for r in out.collect()) == [(i, -2 if i < 3000 else 2 * i) for i in range(4500)]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_sums_over_subtrees(spark, shape):
    rng, n = random.Random(3), 400
    parent = [None] + [{"chain": k - 1, "star": 0, "random": rng.randrange(k)}[shape] for k in range(1, n)]
    depth, own = [0] * n, [rng.randrange(10) for _ in range(n)]
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    whole = own[:]
    for k in sorted(range(1, n), key=lambda k: -depth[k]):
        whole[parent[k]] += whole[k]
    nodes = spark.createDataFrame([(k, depth[k], parent[k], own[k]) for k in range(n)], "key long, depth long, parent long, x long")
    parts = nodes.select("key", "x")
    for more in rolled_up(nodes, ["x"]):
        parts = parts.unionByName(more)
    assert sorted((r.key, r.x) for r in parts.groupBy("key").agg(F.sum("x").alias("x")).collect()) == list(enumerate(whole))
