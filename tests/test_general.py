"""%g of single-precision values against C's; methylated strands and codes against plain versions."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from siglake.functions import signal as S
from siglake.operators.emit import general, printed


def test_general(spark):
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 1.0, -1.5, 100000.5, 100001.5, 999999.5, 999999.4, 1e6, 1234567.0, 9.999995, 9.9999996, 0.0001, 0.00009999, 0.00012345675, 1e-5, 123456.5, 0.1, 3.14159265, 1e20, -2.5e-10, float("inf"), float("-inf"), 99999.95, 12345.25, 12345.75]
    values += (rng.normal(size=500) * 10.0 ** rng.integers(-6, 8, 500)).tolist()
    values = [float(np.float32(v)) for v in values]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = {r.k: r.g for r in d.select("k", general(F.col("v")).alias("g")).collect()}
    assert [got[k] for k in range(len(values))] == ["0" if v == 0 else f"{v:g}" for v in values]
    listed = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", general).alias("g")).first().g
    assert listed == [got[k] for k in range(len(values))]


def test_printed_with_five_digits(spark):
    rng = np.random.default_rng(5)
    values = [0.000005, 0.5, 85899.34592, 123456.000005, 999999.999995, 1e8 + 0.123455, *(rng.random(300) * 10.0 ** rng.integers(0, 9, 300)).tolist(), 0.0000015, 2.5e-6]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    for digits in (0, 2, 3, 5, 6):
        got = {r.k: r.g for r in d.select("k", printed(F.col("v"), digits).alias("g")).collect()}
        assert [got[k] for k in range(len(values))] == [f"{v:.{digits}f}" for v in values]


def other_strand(seq):
    out, i = [], 0
    while i < len(seq):
        if seq[i] == "M":
            out.append("GM"[: min(2, len(seq) - i)])
            i += 2
        else:
            out.append("TGCA"["ACGT".index(seq[i])])
            i += 1
    return "".join(reversed("".join(out)))


def test_methylated_strands(spark):
    random.seed(6)
    seqs = ["", "M", "MG", "GMG", "CGMG", "MGMGM", "ACGM", "G"] + ["".join(random.choice(["A", "C", "G", "T", "MG"]) for _ in range(20)) + random.choice(["", "M"]) for _ in range(50)]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k long, s string")
    got = {r.k: r.o for r in d.select("k", S.reverse_complement_methylated(F.col("s")).alias("o")).collect()}
    assert [got[k] for k in range(len(seqs))] == [other_strand(s) for s in seqs]


def test_codes(spark):
    kmers = ["", "A", "N", "MGN", "RYK", "AXC", "acg", "VHDB"]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(kmers)], "k long, s string")
    rows = sorted(d.select("k", S.expansions(F.col("s")).alias("e"), S.is_valid(F.col("s")).alias("v"), S.ambiguous_count(F.col("s")).alias("n")).collect())
    for s, r in zip(kmers, rows):
        assert r.e == ["".join(p) for p in itertools.product(*(S.SYMBOLS.get(c, "") for c in s))] and r.v == all(c in S.SYMBOLS for c in s)
        assert r.n == sum(c not in "ACGT" for c in s)


def test_reversed_for_rna(spark):
    d = spark.createDataFrame([([(1, 2), (5, 5), (7, 9)],)], "m array<struct<start: int, stop: int>>")
    assert [tuple(x) for x in d.select(S.reversed_map(F.col("m")).alias("m")).first().m] == [(9, 7), (5, 5), (2, 1)]
    assert [tuple(x) for x in d.select(S.reversed_events(F.col("m")).alias("m")).first().m] == [(7, 9), (5, 5), (1, 2)]
