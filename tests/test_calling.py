"""Bounds, checks, read indexes and expressions on small rows with known answers."""

import math

from pyspark.sql import functions as F
from siglake.functions import signal as S
from siglake.operators.calling import event_bounds, run_checks
from siglake.sources.tables import read_read_index, write_read_index


def test_event_bounds(spark):
    pairs = spark.createDataFrame([("a", 0, 5, 0), ("a", 1, 5, 3), ("a", 2, 9, 40), ("b", 0, 7, 1), ("b", 1, 20, 30)], "k string, i long, ref_pos long, event long")
    groups = spark.createDataFrame([("a", 5, 9), ("a", 4, 9), ("a", 6, 9), ("a", 5, 10), ("b", 8, 20), ("c", 1, 2)], "k string, start long, stop long")
    assert sorted(map(tuple, event_bounds(pairs, groups, "k", 10).collect())) == [("a", 5, 9, 0, 40)]
    assert sorted(map(tuple, event_bounds(pairs, groups, "k", -1).collect())) == [("a", 5, 9, 0, 40), ("a", 6, 9, 40, 40), ("b", 8, 20, 30, 30)]


def test_run_checks(spark):
    rows = [(10, 1, 1, 1, 1, 10), (10, 3, 2, 1, 2, 11), (10, 8, 0, 0, 2, 0), (0, 0, 0, 0, 0, 0)]
    out = run_checks(spark.createDataFrame(rows, "total int, bad_quality int, bad_calibration int, bad_alignment int, missing int, low_mapq int")).collect()
    assert [tuple(r)[6:] for r in out] == [(False,) * 5, (True, True, True, False, False), (False, True, True, True, False), (False, False, False, True, True)]


def test_read_index_round_trip(spark, tmp_path):
    rows = [("r2", "/b"), ("r1", "/a c")]
    write_read_index(spark.createDataFrame(rows, "read_id string, path string"), f"{tmp_path}/index")
    assert sorted(map(tuple, read_read_index(spark, f"{tmp_path}/index").collect())) == sorted(rows)
    (tmp_path / "odd").write_text("only\nr1\t/a\nr2\t/b\tmore\n")
    assert [tuple(r) for r in read_read_index(spark, f"{tmp_path}/odd").collect()] == [("r1", "/a")]


def test_expressions(spark):
    lit = F.lit
    d = spark.range(1).select(
        S.standardised_level(lit(5.0), lit(3.0), lit(0.5), lit(4.0)).alias("z"), S.standardised_level(lit(5.0), lit(3.0), lit(0.0), lit(4.0)).alias("inf"), S.standardised_level(lit(3.0), lit(3.0), lit(0.0), lit(4.0)).alias("nan"),
        S.scaled_samples(F.array(*map(lit, (1.0, 4.0, 6.0))), lit(1), lit(2), lit(2.0), lit(2.0)).alias("x"), S.lenient_kmer_rank(lit("NCN")).alias("rank"), S.kmer_rank(lit("ACA")).alias("same"), S.quantile(F.array().cast("array<int>"), 0.5).alias("none"),
    )
    r = d.first()
    assert r.z == 2.0 and r.inf == math.inf and math.isnan(r.nan) and r.x == [1.0, 2.0] and r["rank"] == r.same and r.none is None
