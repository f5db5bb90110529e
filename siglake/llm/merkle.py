"""Merkle manifest of a dataset, with an authentication path for every row.

A row's leaf is the digest of its fields. Leaves stand by language and key; a
language's tree and the tree over the languages' roots have up to eight
children a node, the last node of a level fewer, even one.

1. Leaves are made in the one scan of the texts and written; only digests are
   moved from then on.
2. Their places come from a distributed sort, without a window over a language.
3. Aligned blocks of 8 ** 4 leaves are hashed to a node each, the blocks' nodes
   in blocks again, until every language has one node, and the languages' nodes
   in the same way. A level of blocks is 4096 times smaller than the one below.
4. Paths come down the same way. A task walks its block by fractal traversal:
   for every layer of two levels it holds the subtree over the current leaf and
   builds the next one, a leaf for each path given out, so that every path is at
   hand when its leaf's turn comes and no more than two subtrees a layer are
   held. The path of the block's node, made before, is put behind each.

Edge cases. A null field is hashed as ``-``, an empty text as ``0:``, so they
differ. A null language is a language of its own, which comes first; a null
key comes first in its language. Rows with one key: by their leaves; equal rows
have equal leaves and paths of their own. One row alone: its leaf is the root
and its path is empty. Long texts are hashed whole. Extra columns are ignored,
whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import checked_broadcast, discard, materialize, numbered

ARITY = 8
#: Levels of a block's tree, and of a layer of its traversal.
LEVELS, LAYER = 4, 2
BLOCK = ARITY**LEVELS

NODE = "g string, i bigint, h string, levels int"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """A row's digest."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def fold(start: Column, before: Column, after: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(F.arrays_zip(before.alias("x"), after.alias("y")), start, lambda h, s: F.sha2(F.concat(s["x"], h, s["y"]), 256))


def digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class TreeHash:
    """Hashes leaves that come one by one to the node of level top, and keeps the nodes of the levels asked for. Holds one open run a level besides."""

    def __init__(self, top: int, keep=()):
        self.top, self.open, self.kept, self.node = top, [[] for _ in range(top)], {level: [] for level in keep}, None

    def push(self, node: str, level: int = 0) -> None:
        while True:
            if level in self.kept:
                self.kept[level].append(node)
            if level == self.top:
                self.node = node
                return
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest(run)
            run.clear()
            level += 1

    def close(self) -> TreeHash:
        """The leaves have ended: open runs become nodes as they are."""
        for level, run in enumerate(self.open):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, level + 1)
        return self


def successive_paths(leaves: list[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a block in turn, level by level: the digests before and after its own in its run."""
    layers = [(low, min(low + LAYER, levels)) for low in range(0, levels, LAYER)]
    existing, desired = [], []
    for low, high in layers:
        first = TreeHash(high, range(low, high))
        for node in leaves[: ARITY**high]:
            first.push(node)
        existing.append(first.close().kept)
        desired.append(TreeHash(high, range(low, high)))
    for n in range(len(leaves)):
        before, after = [], []
        for k, (low, high) in enumerate(layers):
            span = ARITY**high
            if n and n % span == 0:
                existing[k] = desired[k].close().kept
                desired[k] = TreeHash(high, range(low, high))
            if n + span < len(leaves):
                desired[k].push(leaves[n + span])
            for level in range(low, high):
                at = (n % span) // ARITY**level
                run = at - at % ARITY
                nodes = existing[k][level]
                before.append("".join(nodes[run:at]))
                after.append("".join(nodes[at + 1 : run + ARITY]))
        yield before, after


def block_roots(nodes: DataFrame) -> DataFrame:
    """The node of each aligned block; levels: how many are left above it."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        levels = int(rows["levels"].iloc[0])
        tree = TreeHash(min(levels, LEVELS))
        for node in rows["h"]:
            tree.push(node)
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "i": [int(rows["i"].iloc[0]) // BLOCK], "h": [tree.close().node], "levels": [max(levels - LEVELS, 0)]})

    return nodes.select("g", "i", "h", "levels").groupBy("g", F.expr(f"i div {BLOCK}")).applyInPandas(root, NODE)


def authenticate(nodes: DataFrame, levels: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes without their place, and before and after, their paths, and what above has of their trees.

    levels: of the highest tree. above: gives the path (before, after) and more columns for the tops (g, i, h) of all trees."""
    blocks = materialize(block_roots(nodes), "blocks")
    upper = above(blocks) if levels <= LEVELS else authenticate(blocks.withColumn("at", F.col("i")), levels - LEVELS, above).withColumnRenamed("at", "i")
    kept = [f for f in nodes.schema if f.name not in ("i", "levels")]
    more = [f for f in upper.schema if f.name not in ("g", "i", "h", "before", "after")]
    out = [*kept, *more]

    def paths(own: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        tail, before, after = over.iloc[0], [], []
        rest_before, rest_after = list(tail["before"]), list(tail["after"])
        for b, a in successive_paths(own["h"].tolist(), min(int(own["levels"].iloc[0]), LEVELS)):
            before.append(b + rest_before)
            after.append(a + rest_after)
        return own[[f.name for f in kept]].assign(**{f.name: tail[f.name] for f in more}, before=before, after=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", before array<string>, after array<string>"
    return nodes.groupBy("g", F.expr(f"i div {BLOCK}")).cogroup(upper.groupBy("g", "i")).applyInPandas(paths, schema)


def planted(leaves: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """leaves (g, h, ...), a materialized table, which goes, with their places and the levels of their tree; the levels of the highest tree."""
    placed = numbered(leaves, ["g"], order, name)
    sizes = materialize(leaves.groupBy("g").agg(F.expr(f"cast(size(filter(sequence(0, 20), k -> power({ARITY}, k) < count(*))) as int)").alias("levels")), f"{name}-sizes")
    discard(leaves)
    most = sizes.agg(F.max("levels")).first()[0] or 0
    return placed.join(checked_broadcast(sizes), "g"), most


def manifest(documents: DataFrame, *, fields: tuple[str, ...], key: str, group: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot (of its group), root, before and after (the path: digests on either side, level by level) for every row, and the columns of carry."""
    carry = carry or {}
    g = F.concat_ws("", F.when(F.col(group).isNull(), F.lit("")).otherwise(F.lit("=")), F.col(group))  # a null first, and as a text
    made = documents.select(g.alias("g"), F.col(key).alias("key"), leaf(*map(F.col, fields)).alias("h"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    leaves, levels = planted(materialize(made, "leaves"), ["key", "h"], "leaves-by-place")

    def over_groups(tops: DataFrame) -> DataFrame:
        roots, high = planted(materialize(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "tops"), ["name"], "subroots")
        at_top = lambda t: t.select("g", "i", F.col("h").alias("root"), F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"))
        found = authenticate(roots, high, at_top)
        return materialize(found.select(F.col("name").alias("g"), F.lit(0).cast("bigint").alias("i"), F.col("h").alias("subroot"), "root", "before", "after"), "paths")

    out = authenticate(leaves, levels, over_groups)
    return out.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "before", "after", *[F.col(f"c_{n}").alias(n) for n in carry])
