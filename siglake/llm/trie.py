"""Prefix trie of conversations: what conversations share from their first turn on, rolled up to all ancestors.

A node is a distinct sequence of first turns. No node's sequence is ever held:

1. Turns become digests in the one scan of the texts, and get their places by a
   distributed sort, as one conversation may hold any share of all turns.
2. A prefix is known by the sums of eight 32-bit pieces of the digests of its
   turns, each hashed with its depth. Sums need no chain from turn to turn, so
   prefixes are running sums within pieces of 4096 turns, onto which the sums of
   earlier pieces are added. A node's key is 128 bits of the digest of depth and
   sums; its parent's key follows from the sums without the last turn.
3. Pointer jumping: every node starts with its parent as its pointer and its
   own values. In round k nodes add what they have to the node their pointer
   names, 2 ** k above them, and take over that node's pointer. What a node has
   then covers all descendants nearer than 2 ** (k + 1), so the rounds are the
   logarithm of the greatest depth, and each works on nodes deeper than 2 ** k
   alone. Contributions are partial aggregates and join only distinct keys;
   pointers to nodes that over a thousandth of the others point to are
   broadcast, of which there can be a thousand at most.
4. The conversations that end at a node are joined to lists of up to 4096 ids in
   order, which one stream per node digests; a list is never in memory whole.

Edge cases. Null role or text: empty. Null turn: first; turns with one number go
by their digests, so equal turns are in any order. Rows without conv_id belong
to no conversation. Repeated rows are turns of their own. Empty and long texts:
digested whole, code points counted. Extra columns are ignored. Empty table: no
rows, not even the root. A conversation without turns is a member of the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import checked_broadcast, discard, hot_join, materialize, numbered

#: Turns or ids handled as one piece.
PIECE = 4096
SUMS, MODULUS = 8, 1 << 32


def turn_digest(role: Column, text: Column) -> Column:
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest and size (code points) of every turn."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"), turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    placed = numbered(turns, ["conv"], ["turn", "digest"], "turns")
    return materialize(placed.select("conv", (F.col("i") + 1).alias("pos"), "digest", "size"), "turns-by-place")


def with_shared_openings(turns: DataFrame, every: int, opening: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of another: the first ``opening`` (a column of conv, at most longest) turns of conversation conv - conv % every (the remainder has conv's sign), then the conversation's own after as many.

    Gives the conversations (conv, total turns) and their turns (conv, depth, digest, size, total)."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base, h = F.col("conv") - F.col("conv") % every, opening.cast("bigint")
    first = turns.where((F.col("conv") % every == 0) & (F.col("pos") <= longest)).select(F.col("conv").alias("base"), "pos", "digest", "size")
    there = first.groupBy("base").agg(F.count("*").alias("there"))
    plan = sizes.select("conv", "n", base.alias("base"), h.alias("h")).join(there, "base", "left").withColumn("start", F.least("h", F.coalesce("there", F.lit(0).cast("bigint"))))
    plan = materialize(plan.select("conv", "base", "n", "h", "start", (F.col("start") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    hot = materialize(hot_keys(plan.select("conv", "n"), "conv", "n"), "hot")
    own = hot_join(turns.where(F.col("pos") > h), plan.select("conv", "start", "h", "total"), "conv", hot)
    own = own.select("conv", (F.col("start") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size", "total")
    shared = plan.join(first, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "size", "total")
    return plan.select("conv", "total"), shared.union(own)


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """The keys with more than a share-th of all rows, so fewer than share. counts: key, n."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * share > total).select(key)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv, depth, digest, size, total) with key and parent, the keys of the prefixes with and without the turn."""
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    parts = [F.conv(F.substring("salted", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"p{k}") for k in range(SUMS)]
    rows = turns.select("conv", "depth", "size", "total", F.expr(f"depth div {PIECE}").alias("piece"), salted.alias("salted")).select("*", *parts).drop("salted")
    rows = materialize(rows, "digests")
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    deep = rows.where(f"total >= {PIECE}").groupBy("conv", "piece").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(SUMS)])
    deep = deep.select("conv", "piece", *[F.sum(f"p{k}").over(earlier).alias(f"e{k}") for k in range(SUMS)]).where("piece > 0")
    rows = rows.join(checked_broadcast(materialize(deep, "earlier")), ["conv", "piece"], "left")
    within = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(f"p{k}").over(within) + F.coalesce(f"e{k}", F.lit(0))).alias(f"s{k}") for k in range(SUMS)]
    rows = rows.select("conv", "depth", "size", "total", *[f"p{k}" for k in range(SUMS)], *sums)
    parent = _key(F.col("depth") - 1, [F.col(f"s{k}") - F.col(f"p{k}") for k in range(SUMS)])
    own = _key(F.col("depth"), [F.col(f"s{k}") for k in range(SUMS)])
    return rows.select("conv", "depth", "size", "total", own.alias("key"), parent.alias("parent"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth, *[s % MODULUS for s in sums]), 256), 1, 32))


def root_key() -> Column:
    return _key(F.lit(0).cast("bigint"), [F.lit(0).cast("bigint")] * SUMS)


def list_digests(ends: DataFrame) -> DataFrame:
    """key and the digest of its ids, ascending, joined by commas. ends: key, conv (unique)."""
    counts = ends.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {PIECE}").select("key")
    many = checked_broadcast(materialize(counts, "many"))
    pieced = numbered(ends.join(many, "key", "left_semi"), ["key"], ["conv"], "ends-by-place").select("key", "conv", F.expr(f"i div {PIECE}").alias("piece"))
    rest = ends.join(many, "key", "left_anti").select("key", "conv", F.lit(0).cast("bigint").alias("piece"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = rest.union(pieced).groupBy("key", "piece").agg(ids.alias("ids"))

    def streamed(batches):
        at, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if key == at:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    keys.append(at)
                    found.append(state.hexdigest())
                at, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends": pa.array(found, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([at], pa.binary()), "ends": pa.array([state.hexdigest()], pa.string())})

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(streamed, "key binary, ends string")


def rolled_up(nodes: DataFrame, values: list[str]) -> list[DataFrame]:
    """Tables of key and values whose sums by key, with the nodes' own, are those over each node's subtree. nodes: key, depth, parent, and values."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = nodes.where("depth >= 1").select("key", "depth", F.col("parent").alias("pointer"), *values)
    found, reach = [], 1
    while reach <= deepest:
        given = materialize(active.groupBy("pointer").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n")), "given")
        found.append(given.select(F.col("pointer").alias("key"), *values))
        reach *= 2
        if reach > deepest:
            break
        hot = materialize(hot_keys(given.select("pointer", "n"), "pointer", "n"), "hot")
        more = given.select(F.col("pointer").alias("key"), *[F.col(v).alias(f"more_{v}") for v in values])
        grown = active.where(f"depth >= {reach}").join(more, "key", "left")
        grown = grown.select("key", "depth", "pointer", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        above = active.select(F.col("key").alias("pointer"), F.col("pointer").alias("next"))
        jumped = hot_join(materialize(grown, "grown"), above, "pointer", hot)
        active = materialize(jumped.select("key", "depth", F.col("next").alias("pointer"), *values), "pointers")
    return found


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. conversations: conv, total; turns: conv, depth (1 to total), digest, size, total."""
    edges = materialize(prefixes(turns), "edges")
    nodes = edges.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "parent", "size")])
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(root_key().alias("key"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("size"))
    nodes = materialize(nodes.union(root), "nodes")
    children = materialize(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    own = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").select(
        "key", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("n_children").isNull().cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    own = materialize(own, "own")
    ends = edges.where("depth = total").select("key", "conv").union(conversations.where("total = 0").select(root_key(), "conv"))
    digests = list_digests(ends)
    facts, sums = ["conv_id", "depth", "parent", "n_convs", "n_children"], ["n_leaves", "saved_tokens"]
    rows = own.select("key", *facts, *sums, F.lit(None).cast("string").alias("ends"))
    for more in [*rolled_up(own, sums), digests]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    whole = rows.groupBy("key").agg(*[F.max(c).alias(c) for c in facts], *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"))
    whole = materialize(whole.drop("key"), "whole")
    hot = materialize(hot_keys(children, "parent", "n_children"), "hot")
    below = hot_join(whole.where("parent is not null"), own.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", hot)
    out = below.unionByName(whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    discard(edges)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
