"""Slices, signals, runs of events on samples, trimming, and a run's counters, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.operators import events as E
from siglake.operators import pairs as P
from siglake.operators import reads as R
from siglake.operators import run as run_
from siglake.operators import signals as G
from siglake.operators import slices as L


def test_slices_over_tiles_and_ends(spark):
    rng = np.random.default_rng(1)
    whole = {"a": "".join(rng.choice(list("ACGT"), 1000)), "b": "ACGT", "empty": ""}
    lines = [("a", k, whole["a"][k * 61 : k * 61 + 61]) for k in range(17)] + [("b", 0, "AC"), ("b", 1, "GT"), ("empty", 0, "")]
    ref = L.placed_lines(spark.createDataFrame(lines, "contig string, ord long, seq string").repartition(5))
    spans = [("a", 0, 0), ("a", 63, 64), ("a", 0, 5000), ("a", 990, 999), ("a", 990, 1000), ("a", 1000, 1100), ("a", 128, 191), ("b", 1, 2), ("b", -3, 1), ("c", 1, 2), ("empty", 0, 3), ("a", 10, 5)]
    alns = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)] + [(100 + k, "a", k, k + 300) for k in range(600)], "id long, contig string, pos long, ref_end long")
    got = {r.id: r.ref_seq for r in L.reference_slices(alns, ref, ["id"], tile=64).collect()}
    for k, (c, low, high) in enumerate(spans):
        assert got[k] == (None if c == "c" else whole[c][max(low, 0) : high + 1] if low <= high else ""), spans[k]
    assert all(got[100 + k] == whole["a"][k : k + 301] for k in range(600))


@pytest.mark.parametrize("ascii_only", [True, False])
def test_bases_are_not_shuffled(spark, monkeypatch, ascii_only):
    rng = np.random.default_rng(2)
    whole = "".join(rng.choice(list("ACGT"), 40_000))
    whole = whole if ascii_only else whole.replace("AC", "Ä")[:30_000].ljust(40_000, "ß")
    ref = spark.createDataFrame([("a", k, whole[k : k + 70]) for k in range(0, 40_000, 70)], "contig string, start long, seq string")
    lengths = [1, 63, 64, 65, 511, 512, 513, 4095, 4096, 4097, 30_000]
    spans = [(n, int(low)) for n in lengths for low in rng.integers(0, 40_000, 30)]
    alns = spark.createDataFrame([(k, "a", low, low + n - 1) for k, (n, low) in enumerate(spans)], "id long, contig string, pos long, ref_end long")
    for bases in (64 << 20, 0):
        monkeypatch.setattr(L, "BROADCAST_BASES", bases)
        out = L.reference_slices(alns, ref, ["id"], tile=64)
        assert {r.id: r.ref_seq for r in out.collect()} == {k: whole[low : low + n] for k, (n, low) in enumerate(spans)}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == plan.count("Aggregate [contig") == 2  # of the reference; none gathers what an alignment lies on


def test_signals_are_pruned_before_they_are_shuffled(spark):
    wide = spark.range(20_000).selectExpr("id as read_id", "array(id, id + 1) as samples", "4000D as sample_rate")
    rows = spark.range(0, 20_000, 100).selectExpr("id as read_id", "id % 7 as x")
    kept = G.prunable(wide, rows.select("read_id"), "read_id").count()
    assert 200 <= kept < 220
    out = G.with_signals(rows, wide)
    assert out.count() == 200 and {r.read_id: r.samples[1] for r in out.collect()}[300] == 301


def test_missing_signals(spark):
    signals = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None)], "read_id string, samples array<int>")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "read_id string")
    assert [r.read_id for r in G.with_signals(rows, signals).collect()] == ["a"]
    for name in "bcd":
        with pytest.raises(Exception, match=f"no signal for read {name}"):
            G.with_signals(rows.where(f"read_id = '{name}'"), signals, "abort").collect()
    assert G.with_signals(rows.where("read_id = 'a'"), signals, "abort").count() == 1
    with pytest.raises(ValueError, match="skip or abort"):
        G.with_signals(rows, signals, "other")


@pytest.mark.parametrize("backwards", [False, True])
def test_runs_on_samples(spark, backwards):
    """A run takes the samples from its earlier to its later end, those between its events too; a run of one keeps its event's values."""
    rng = np.random.default_rng(2)
    x = rng.integers(300, 900, 400).tolist()
    starts = list(range(0, 390, 13))[:: -1 if backwards else 1]
    pos = np.cumsum(rng.integers(0, 2, len(starts))).tolist()
    rows = [("r", i, p, 50 + i, f"k{i}", s, 9 + i % 4, float(i), i / 8) for i, (s, p) in enumerate(zip(starts, pos))]
    rows += [("none", 0, 1, 0, "k", 0, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "read_id string, i long, ref_pos long, event_index long, model_kmer string, start long, length long, mean double, stdv double").repartition(4)
    signals = spark.createDataFrame([("r", x, 4000.0), ("other", x, 4000.0)], "read_id string, samples array<int>, sample_rate double")
    got = sorted(G.collapse_raw(df, signals).collect(), key=lambda r: r.event_index)
    want, k = [], 0
    while k < len(pos):
        n = sum(p == pos[k] for p in pos[k:])
        first, last = rows[k], rows[k + n - 1]
        a, z = min(first[5], last[5]), max(first[5] + first[6], last[5] + last[6])
        part = np.array(x[a:z], dtype=float)
        want.append((pos[k], 50 + k, f"k{k}", a, z, *((part.mean(), part.std()) if n > 1 else first[7:9]), (z - a) / 4000))
        k += n
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert tuple(r)[1:6] == w[:5] and np.allclose(tuple(r)[6:], w[5:])


def test_trimming(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in [0, 1, 2, 3, 50, 1000]:
        ref, read = (np.cumsum(rng.integers(0, 3, n)).tolist() for _ in range(2))
        rows.append((n, [{"ref_pos": a, "read_pos": b} for a, b in zip(ref, read)]))
    d = spark.createDataFrame(rows, "n long, p array<struct<ref_pos: long, read_pos: long>>")
    p = F.col("p")
    for low, high in ((0, 10), (5, 5), (30, 20), (40, 1_000_000), (-5, 0)):
        lit = F.lit
        out = d.select("n", P.trim_to_region(p, lit(low), lit(high)).alias("a"), P.trim_to_kmer(p, lit(high)).alias("b"), P.end_pair(p, lit(high), lit(2)).alias("c"), P.inner_pairs(p, lit(3), lit(60)).alias("d"))
        for (n, pairs), r in zip(rows, sorted(out.collect(), key=lambda r: r.n)):
            as_dicts = lambda v: [x.asDict() for x in v]
            assert as_dicts(r.a) == [x for x in pairs if low <= x["ref_pos"] <= high]
            last = max((i for i, x in enumerate(pairs) if x["read_pos"] <= high), default=-1)
            assert as_dicts(r.b) == pairs[: last + 1]
            at = next((i for i in range(2, n) if pairs[i]["ref_pos"] > high), max(n, 2))
            assert r.c == at - 1
            assert as_dicts(r.d) == [x for x in pairs if x["read_pos"] >= 3 and x["read_pos"] + 3 < 60]


def test_degenerate(spark):
    d = spark.createDataFrame([(0, []), (1, [(4, 1)]), (2, [(4, 1), (5, 2), (6, 1)]), (3, [(4, 1), (5, 2)])], "n long, p array<struct<ref_pos: long, event: long>>")
    assert [len(r.p) for r in d.select("n", P.unless_degenerate(F.col("p")).alias("p")).orderBy("n").collect()] == [0, 0, 0, 2]


STATS = "flag int, mapq int, n_bases long, n_samples long, status int"


def test_counters_of_a_run(spark, tmp_path):
    rows = [(0, 60, 100, 10, 0), (4, 60, 100, 10, 0), (4, 0, 100, 10, 0), (0, 5, 100, 10, 0), (256, 60, 100, 10, 0), (0, 60, 9000, 10, 0), (0, 60, 100, None, 0), (0, 60, 100, 0, 0), (16, 60, 50, 10, 1), (0, 60, 100, 10, 2), (0, 60, 100, 10, 4), (2048, 60, 70, 10, 0)]
    out = run_.run(spark.createDataFrame(rows, STATS).repartition(3), f"{tmp_path}/r", long=1000).first()
    assert [out[c] for c in run_.COUNTERS] == [8, 2, 1, 1, 1, 2, 1, 1, 1, 2, 420]
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2 and out.warn_missing and not out.error_all_failed and not out.warn_failed
    empty = run_.run(spark.createDataFrame([], STATS), f"{tmp_path}/e").first()
    assert empty.total == 0 and empty.error_empty
    with pytest.raises(RuntimeError, match="0 reads"):
        run_.run(spark.createDataFrame([], STATS), f"{tmp_path}/f", strict=True)
    with pytest.raises(RuntimeError, match="all 1 reads failed"):
        run_.run(spark.createDataFrame(rows[9:10], STATS), f"{tmp_path}/g", strict=True)


def test_moments_of_one_value(spark):
    e = spark.createDataFrame([("r", 5.0)] * 3, "k string, mean double")
    m = spark.createDataFrame([("r", 2.0)] * 4, "k string, level_mean double")
    r = E.moment_scaling(e, m, "k").first()
    assert (r["shift"], r["scale"]) == (3.0, 1.0)


def test_paths(spark):
    alns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "read_id string, n int")
    index = spark.createDataFrame([("a", "/x"), ("b", ""), ("z", "/z")], "read_id string, path string")
    rows = lambda mode: sorted((r.n, r.path) for r in R.with_paths(alns, index, mode).collect())
    assert rows("skip") == [(1, "/x"), (2, "/x")] and rows("keep") == [(1, "/x"), (2, "/x"), (3, None), (4, None), (5, None)]
    with pytest.raises(Exception, match="no signal path for read c"):
        R.with_paths(alns.where("read_id = 'c'"), index, "abort").collect()
