"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards of about ``shard_words`` words and
sorts all suffixes of a shard into a suffix array, by prefix doubling to the
length of the longest benchmark item, beyond which no match can go. Every suffix
of every benchmark item is then binary-searched in every shard: its neighbours
in the array tell the longest match, and where that reaches ``window`` words, two
more binary searches give the range of all places that share as much. The match
at each place runs to the first word that differs; a match that also agrees in
the word before it is part of a longer one and is left to that.

What a document is removed by needs no list of all those pairs of places: the
suffixes that share a window have one range of places, their items are one set
that is kept once however many places it has, and the longest match at a place
is with one of its two neighbours among the sorted suffixes of the items. So a
stem of thousands of items costs its places and its items, not their product.
The benchmark is the stated query set: it goes to the executors in blocks of at most
``block_words`` words, so memory is bounded by a block and a shard, and nothing
is shuffled.

Runs of words that are in no item, and runs of item words too short for a
window, can't be part of a match; each such stretch is one gap in the array.

Edge cases. Null or empty text: no words, a row with zeros. Null item text or
an item without words: no window. Item shorter than ``window``: one window of
all its words. Repeated documents: a row each. Repeated items: counted once by
item_id; a null item_id marks words as hit but is not listed. A text longer than
a shard: a shard of its own. Empty tables: no rows, or no hits. Extra columns are
ignored unless carry names them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from siglake.llm.common import materialize

#: A-Z to a-z, digits and bytes of 0x80 or more kept, everything else a gap.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

HITS = "array<struct<start:int,n:int,item_id:string,item_start:int>>"
SPANS = "struct<spans:array<struct<start:int,n:int>>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def prefix_ranks(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until depth words are compared."""
    levels, size = [ids], 1
    while size < depth:
        after = np.zeros(len(ids), np.int64)
        after[:-size] = levels[-1][size:]
        pairs = levels[-1] * (int(levels[-1].max()) + 1) + after
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return levels


def common_words(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words the suffixes at p and q share."""
    n, last = np.zeros(len(p), np.int64), len(levels[0]) - 1
    for k in reversed(range(len(levels))):
        n += (levels[k][np.minimum(p + n, last)] == levels[k][np.minimum(q + n, last)]).astype(np.int64) << k
    return n


class Block:
    """Some items as word numbers, each item closed by a number that no document has; 0 is any other word."""

    PAIRS = 1 << 20

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        texts = {(item, tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)) for item, words in items}
        texts = sorted(texts, key=lambda x: (x[0] is None, x[0] or "", x[1]))
        self.items = [item for item, _ in texts]
        sizes = np.array([len(t) for _, t in texts], np.int64)
        self.ids = np.array([i for _, t in texts for i in (*t, len(self.vocab) + 1)], np.int64)
        self.item_of = np.repeat(np.arange(len(texts)), sizes + 1)
        self.start_of = np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        at, size = np.arange(len(self.ids)) - self.start_of, np.repeat(sizes, sizes + 1)
        self.window = window
        self.need = np.minimum(size, window)  # words a match must have
        self.suffixes = np.flatnonzero(at + self.need <= size)
        self.longest, self.least = int(sizes.max(initial=0)), int(sizes.clip(max=window).min(initial=window))

    def ranges(self, docs: list[np.ndarray]):
        """The suffix array of a shard, and for each item suffix whose first words stand in it the range of their places."""
        if not docs or not len(self.ids):
            return None
        starts = np.cumsum([1] + [len(x) + 1 for x in docs])
        ids = np.zeros(starts[-1], np.int64)
        for at, x in zip(starts, docs):
            ids[at : at + len(x)] = x
        gaps = np.flatnonzero(ids == 0)
        runs = np.diff(gaps, append=len(ids)) - 1
        ids[np.repeat(runs < self.least, runs + 1)] = 0
        place = np.flatnonzero((ids != 0) | np.append(True, ids[:-1] != 0))  # one gap for each stretch without a match
        if len(place) < 2:
            return None
        both = np.concatenate([ids[place], self.ids[-1:], self.ids])
        levels, shift = prefix_ranks(both, self.longest + 1), len(place) + 1
        known = np.flatnonzero(both[: len(place)])
        array = known[np.argsort(levels[-1][known], kind="stable")]
        suffixes = self.suffixes + shift
        at = np.searchsorted(levels[-1][array], levels[-1][suffixes])
        longest = np.maximum(common_words(levels, suffixes, array[np.maximum(at - 1, 0)]), common_words(levels, suffixes, array[np.minimum(at, len(array) - 1)]))
        long = longest >= self.need[self.suffixes]
        suffixes, at, need = suffixes[long], at[long], self.need[self.suffixes[long]]

        def bound(lo, hi, inside_is_left):
            while (open_ := lo < hi).any():
                middle = (lo + hi) // 2
                inside = common_words(levels, suffixes, array[np.minimum(middle, len(array) - 1)]) >= need
                right = inside if inside_is_left else ~inside
                lo, hi = np.where(open_ & right, middle + 1, lo), np.where(open_ & ~right, middle, hi)
            return lo

        first, end = bound(np.zeros_like(at), at, False), bound(at, np.full_like(at, len(array)), True)
        return starts, place, both, levels, array, suffixes, need, first, end, shift

    def parts(self, array: np.ndarray, first: np.ndarray, end: np.ndarray):
        """(index of the range, place) for all places of all ranges, in parts of about PAIRS."""
        n = end - first
        part = np.cumsum(n) // self.PAIRS
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            m = n[mine]
            yield np.repeat(mine, m), array[np.repeat(first[mine] - np.cumsum(m) + m, m) + np.arange(m.sum())]

    def search(self, docs: list[np.ndarray]) -> list[list[tuple]]:
        """For each document of a shard all its longest matches (start, length, item, start in the item)."""
        out: list[list[tuple]] = [[] for _ in docs]
        if not (found := self.ranges(docs)):
            return out
        starts, place, both, levels, array, suffixes, _, first, end, shift = found
        for k, p in self.parts(array, first, end):
            q = suffixes[k]
            whole = both[p - 1] != both[q - 1]
            p, q = p[whole], q[whole]
            size, begin, i = common_words(levels, p, q), place[p], q - shift
            d = np.searchsorted(starts, begin, side="right") - 1
            for row in zip(d.tolist(), (begin - starts[d]).tolist(), size.tolist(), self.item_of[i].tolist(), (i - self.start_of[i]).tolist()):
                out[row[0]].append((row[1], row[2], self.items[row[3]], row[4]))
        return out

    def summary(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each document of a shard the longest matches (start, length) that no other holds, and its items, null ones left out."""
        out: list[tuple[list, list]] = [([], []) for _ in docs]
        if not (found := self.ranges(docs)):
            return out
        starts, place, _, levels, array, suffixes, need, first, end, shift = found
        if not len(suffixes):
            return out
        order = np.lexsort((need, end, first))
        suffixes, need, first, end = (x[order] for x in (suffixes, need, first, end))
        new = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(end) != 0) | (np.diff(need) != 0)))
        sets: dict[bytes, int] = {}
        set_of = np.array([sets.setdefault(np.unique(self.item_of[x - shift]).tobytes(), len(sets)) for x in np.split(suffixes, new[1:])])
        need, first, end = need[new], first[new], end[new]
        least, pairs = np.zeros(len(place), np.int64), np.empty(0, np.int64)  # the longest window at each place; documents and sets
        for k, p in self.parts(array, first, end):
            np.maximum.at(least, p, need[k])
            d = np.searchsorted(starts, place[p], side="right") - 1
            pairs = np.unique(np.concatenate([pairs, d * len(sets) + set_of[k]]))
        p = np.flatnonzero(least)
        items = self.suffixes + shift
        items = items[np.argsort(levels[-1][items], kind="stable")]
        at = np.searchsorted(levels[-1][items], levels[-1][p])
        size = np.maximum(common_words(levels, p, items[np.maximum(at - 1, 0)]), common_words(levels, p, items[np.minimum(at, len(items) - 1)]))
        size = np.where(size >= self.window, size, least[p])  # items shorter than a window match whole
        begin = place[p]
        held = np.append(False, (np.diff(begin) == 1) & (size[:-1] > size[1:]))
        begin, size = begin[~held], size[~held]
        d = np.searchsorted(starts, begin, side="right") - 1
        for k, b, n in zip(d.tolist(), (begin - starts[d]).tolist(), size.tolist()):
            out[k][0].append((b, n))
        lists = [np.frombuffer(x, np.int64) for x in sets]
        d, which = pairs // len(sets), pairs % len(sets)
        cut = np.flatnonzero(np.diff(d)) + 1
        for k, x in zip(d[np.append(0, cut)].tolist(), np.split(which, cut)):
            every = np.unique(np.concatenate([lists[j] for j in x.tolist()]))
            out[k][1].extend(sorted({self.items[j] for j in every.tolist()} - {None}))
        return out


def blocks(benchmark: DataFrame, window: int, block_words: int):
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator()
    held, n = [], 0
    for item, text in rows:
        words = words_of(bytes(text) if text is not None else None)
        if n + len(words) > block_words and held:
            yield Block(held, window)
            held, n = [], 0
        if words:
            held.append((item, words))
            n += len(words)
    yield Block(held, window)


def find_matches(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 1_000_000, shard_words: int = 400_000, carry: Sequence[str] = ("doc_id",), pairs: bool = True) -> DataFrame:
    """The columns named in carry, n_words and hits, the longest verbatim matches with their places, for every document. Without pairs, hits are the spans of a document that no other span holds, and its items."""
    spark = documents.sparkSession
    carry = [c for c in carry if c not in ("_text", "n_words", "hits")]
    todo = documents.select(*carry, F.col("text").cast("binary").alias("_text"))
    schema = StructType([*todo.schema.fields, StructField("n_words", LongType()), StructField("hits", DataType.fromDDL(HITS if pairs else SPANS))])
    span = [("start", pa.int32()), ("n", pa.int32())]
    kind = pa.list_(pa.struct([*span, ("item_id", pa.string()), ("item_start", pa.int32())])) if pairs else pa.struct([("spans", pa.list_(pa.struct(span))), ("items", pa.list_(pa.string()))])
    first = True
    for block in blocks(benchmark, window, block_words):
        if not first:  # one block at a time is held by the tasks
            todo = materialize(todo, "decontaminate")
        held = spark.sparkContext.broadcast(block)

        def search(batches, held=held, first=first):
            block = held.value

            def searched(shard):
                ids = []
                for text in shard["_text"]:
                    words = words_of(text.as_py())
                    ids.append(np.fromiter(map(block.vocab.get, words, repeat(0)), dtype=np.uint32, count=len(words)))
                if pairs:
                    hits = [[dict(zip(("start", "n", "item_id", "item_start"), x)) for x in found] for found in block.search(ids)]
                    hits = hits if first else [a + b for a, b in zip(shard["hits"].to_pylist(), hits)]
                else:
                    hits = [{"spans": [{"start": b, "n": n} for b, n in spans], "items": items} for spans, items in block.summary(ids)]
                    hits = hits if first else [{c: a[c] + b[c] for c in a} for a, b in zip(shard["hits"].to_pylist(), hits)]
                return pa.RecordBatch.from_arrays([*(shard[c] for c in carry), shard["_text"], pa.array([len(x) for x in ids], pa.int64()), pa.array(hits, kind)], names=[*carry, "_text", "n_words", "hits"])

            for batch in batches:
                begin, size = 0, 0
                for k, text in enumerate(batch["_text"]):
                    size += len(text.as_buffer() or b"") if text.is_valid else 0
                    if size > 6 * shard_words or k + 1 == batch.num_rows:  # a word and its gap take about six bytes
                        yield searched(batch.slice(begin, k + 1 - begin))
                        begin, size = k + 1, 0

        todo = todo.mapInArrow(search, schema)
        first = False
    return todo.drop("_text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, carry: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The columns named in carry, spans and items of find_matches and their digests for every document; ``contaminated`` is what to remove by.

    n_hit counts words inside any match once, by a sweep over the sorted matches."""
    swept = F.expr(
        "aggregate(array_sort(transform(hits.spans, h -> struct(h.start as s, h.start + h.n as e))), struct(0 as e, 0 as n),"
        " (a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.s)) as n), a -> cast(a.n as bigint))"
    )
    items = F.array_sort(F.array_distinct("hits.items"))
    added = {
        "n_words": F.col("n_words"),
        "n_hit": swept,
        "n_items": F.size(items).cast("bigint"),
        "items_sha256": F.sha2(F.array_join(items, ","), 256),
        "contaminated": F.size("hits.spans") > 0,
        "longest_match": F.coalesce(F.array_max("hits.spans.n"), F.lit(0)).cast("bigint"),
        "spans": F.col("hits.spans"),
        "items": items,
    }
    carry = [c for c in carry if c not in added]
    return find_matches(documents, benchmark, carry=carry, pairs=False, **options).select(*carry, *[v.alias(k) for k, v in added.items()])
