"""Aligned pairs of a read as one sorted array: trimming by binary search, and the pairs that count.

Everything stays in the row; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_beyond(pairs: Column, field: str, bound: Column, at_least: bool = False) -> Column:
    """How many pairs, from the first, have field up to bound (below it, with at_least); pairs ascend in field. A binary search of 32 steps."""
    start = F.struct(F.lit(0).alias("low"), F.size(pairs).alias("high"))

    def halved(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        value = F.get(pairs, middle)[field]
        beyond = value >= bound if at_least else value > bound
        done = a["low"] >= a["high"]
        low = F.when(done | beyond, a["low"]).otherwise(middle + 1)
        return F.struct(low.alias("low"), F.when(done | ~beyond, a["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halved, lambda a: a["low"])


def trim_to_region(pairs: Column, start: Column, end: Column) -> Column:
    """The pairs whose ref_pos lies in start to end, both included."""
    low = first_beyond(pairs, "ref_pos", start, True)
    return F.slice(pairs, low + 1, F.greatest(first_beyond(pairs, "ref_pos", end) - low, F.lit(0)))


def trim_to_kmer(pairs: Column, last: Column) -> Column:
    """The pairs up to the last one whose read_pos is not above last."""
    return F.slice(pairs, F.lit(1), first_beyond(pairs, "read_pos", last))


def end_pair(pairs: Column, most: Column, start: Column) -> Column:
    """The place, from 0, of the last pair from place start on before one whose ref_pos is above most; start - 1 if already that at start is."""
    return F.greatest(first_beyond(pairs, "ref_pos", most), start) - 1


def inner_pairs(pairs: Column, k: Column, read_length: Column) -> Column:
    """The pairs at least k bases from either end of the read."""
    low = first_beyond(pairs, "read_pos", k, True)
    high = first_beyond(pairs, "read_pos", read_length - k, True)
    return F.slice(pairs, low + 1, F.greatest(high - low, F.lit(0)))


def unless_degenerate(pairs: Column, field: str = "event") -> Column:
    """No pairs where the first and the last are mapped to one event."""
    n = F.size(pairs)
    same = (n > 0) & (F.get(pairs, F.lit(0))[field] == F.get(pairs, n - 1)[field])
    return F.when(same, F.slice(pairs, F.lit(1), F.lit(0))).otherwise(pairs)
