"""Word shingles as 64-bit hashes, and connected components; used by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import materialize

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of SplitMix64), so that order by value is random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, dtype=np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


#: Bytes that are looked at together, and the longest word that is hashed among them.
PIECE, LONG = 1 << 18, 64
GAP = np.zeros(256, dtype=bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * FACTOR)
LETTERS[65:91] = LETTERS[97:123]
BASE = 0x9E3779B97F4A7C15
POWERS, INVERSES = _powers(BASE, PIECE), _powers(pow(BASE, -1, 1 << 64), PIECE)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; np.unique takes several times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Shingler:
    """Hashes of all runs of ``width`` words: what stands between white space, with A-Z in lower case.

    Words of many texts are hashed at once. A word is the sum of its letters' values times the powers of an odd number, so it is a difference of running sums, divided by the power it begins with. Words longer than ``LONG`` are hashed one by one and kept in a bounded table."""

    def __init__(self, width: int, remembered: int = 200_000):
        self.width, self.remembered, self.known = width, remembered, {}

    def _long(self, word: bytes) -> int:
        if word not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        return self.known[word]

    def _words(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every word of ``PIECE`` bytes at most; no word goes on over one of the places begins."""
        gap = np.append(GAP[data], True)
        inside = ~gap[:-1]
        first = inside.copy()
        first[1:] &= gap[:-2]
        last = inside & gap[1:]
        begins = begins[begins < len(data)]
        first[begins] = inside[begins]
        begins = begins[begins > 0] - 1
        last[begins] = inside[begins]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(LETTERS[data] * POWERS[: len(data)], out=sums[1:])
        out = mixed((sums[last] - sums[first]) * INVERSES[first])
        for k in np.flatnonzero(last - first > LONG):
            out[k] = self._long(data[first[k] : last[k]].tobytes().lower())
        return out, first

    def _long_text(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one text of any length, in pieces that end at white space."""
        found, at = [], 0
        while at < len(data):
            end, step = min(at + PIECE, len(data)), PIECE
            if end < len(data) and not (GAP[data[end - 1]] or GAP[data[end]]):
                gaps = np.flatnonzero(GAP[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a piece
                    while end < len(data) and not len(gaps):
                        gaps = np.flatnonzero(GAP[data[end : end + step]])
                        end += int(gaps[0]) if len(gaps) else min(step, len(data) - end)
                    found.append(np.array([self._long(data[at:end].tobytes().lower())], dtype=np.uint64))
                    at = end
                    continue
            found.append(self._words(data[at:end], np.empty(0, dtype=np.int64))[0])
            at = end
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)

    def _runs(self, words: np.ndarray) -> np.ndarray:
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = out * FACTOR + words[k : k + len(out)]
        return mixed(out)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For every text of a binary array the hashes of its runs, one per start; for fewer words than the width one hash of them all; none without words or text."""
        if not len(texts):
            return
        texts = texts.fill_null(b"")
        _, at, data = texts.buffers()
        at = np.frombuffer(at, dtype=np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
            own, begins = data[at[i] : at[j]], at[i : j + 1] - at[i]
            if len(own) > PIECE:
                words = self._long_text(own)
                bounds = np.array([0, len(words)])
            else:
                words, places = self._words(own, begins)
                bounds = np.searchsorted(places, begins)
            runs = self._runs(words) if len(words) else words
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield runs[lo : hi - self.width + 1] if hi - lo >= self.width else self._runs(words[lo:hi]) if hi > lo else words[:0]
            i = j

    def of(self, text: bytes | None) -> np.ndarray:
        return next(self.each(pa.array([text], pa.binary())))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """The same for words given one by one, without white space."""
        return self.of(b" ".join(words))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, label (the smallest id reachable) for all ends of edges (a, b).

    Each round takes the smallest label among neighbours and then that label's
    own label, so chains shorten by powers. Sums over a hot end are partial
    aggregates; joins on it are shuffled joins that AQE splits. Edges, labels
    and changes stay distributed; only the count of changes comes back."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("jumped"))
        new = new.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("jumped", "new")).alias("new"))
        new = materialize(new, "labels")
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
