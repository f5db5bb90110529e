"""The writers, and what C prints, against Python's own formatting."""

import random

import pytest
from pyspark.sql import functions as F

from siglake.operators.events import move_summary, weighted_positions
from siglake.operators.frequency import accumulate_bedmethyl, formatted, merge_frequencies
from siglake.operators.kernels import peaks
from siglake.sources import tables


@pytest.mark.parametrize("digits", [2, 3])
def test_formatted_like_c(spark, digits):
    rng = random.Random(digits)
    values = [m / n for n in range(1, 120) for m in range(n + 1)] + [rng.uniform(-2000, 2000) for _ in range(2000)] + [k / 16 for k in range(-64, 64)] + [1.0005, 0.0025, 2.675, 1e5 + 0.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", formatted(F.col("v"), digits).alias("s")).collect()
    for r in got:
        assert r.s == f"{r.v:.{digits}f}" or (r.v == 0 and r.s.strip("-0.") == "")


def test_round_trip_of_tables(spark, tmp_path):
    freq = spark.createDataFrame([("c", 5, 5, 1, 16, 1, 1 / 16, "ACGT"), ("c", 3, 3, 1, 3, 2, 2 / 3, "CG")], tables.FREQ)
    tables.write_frequencies(freq, f"{tmp_path}/f")
    assert [(r.start, r.methylated_frequency) for r in tables.read_frequencies(spark, f"{tmp_path}/f").orderBy("start").collect()] == [(3, 0.667), (5, 0.062)]
    calls = spark.createDataFrame([("c", "+", 1, 1, "r", -2.675, -10.005, -7.5, 1, 1, "CG")], tables.CALLS)
    tables.write_calls(calls, f"{tmp_path}/c")
    r = tables.read_calls(spark, f"{tmp_path}/c").first()
    assert (r.strand, r.log_lik_ratio, r.log_lik_methylated) == ("+", float(f"{-2.675:.2f}"), float(f"{-10.005:.2f}"))


def test_first_row_and_moves_back(spark):
    rows = spark.createDataFrame([(1, i, p, 2) for i, p in enumerate([4, 5, 5, 8, 7])], "read long, i long, ref_pos long, duration long")
    r = move_summary(rows, "read").first()
    assert (r.num_events, r.num_steps, r.num_stays, r.num_skips) == (5, 1, 1, 2)


def test_positions_without_a_match_stay(spark):
    rows = [(1, 0, 7, "A", "A", 10, 1, 2, 3), (1, 1, 7, "A", "N", 99, 9, 9, 9), (1, 2, 8, "C", "N", 5, 1, 1, 1), (1, 3, 7, "A", "A", 4, 1, 1, 1)]
    d = spark.createDataFrame(rows, "read long, i long, ref_pos long, ref_kmer string, model_kmer string, level long, stdv long, length long, duration long")
    out = weighted_positions(d, "read").orderBy("island").collect()
    assert [(r.ref_pos, r.event_length) for r in out] == [(7, 2), (8, 0), (7, 1)]
    assert out[0].event_level_mean == 10 and out[0].event_duration == 3 and out[1].event_level_mean != out[1].event_level_mean


def test_bedmethyl_truncates_as_computed(spark):
    rows = spark.createDataFrame([("c", 10, "+", 100, 29.0), ("c", 11, "-", 100, 50.0)], "chromosome string, start long, strand string, coverage long, percent double")
    assert [tuple(r) for r in accumulate_bedmethyl(rows).collect()] == [("c", 10, 10, 200, int(29 / 100 * 100) + 50)]


def test_merge_takes_the_last_file_and_refuses_other_sequences(spark):
    one = spark.createDataFrame([("c", 1, 1, 1, 4, 2, 0.5, "CG")], tables.FREQ)
    two = spark.createDataFrame([("c", 1, 9, 2, 4, 0, 0.0, "CG")], tables.FREQ)
    r = merge_frequencies([one, two]).first()
    assert (r.end, r.num_motifs_in_group, r.called_sites, r.methylated_frequency) == (9, 2, 8, 0.25)
    with pytest.raises(Exception, match="differ"):
        merge_frequencies([one, two.withColumn("group_sequence", F.lit("AC"))]).collect()


def test_peaks_of_a_step():
    import numpy as np

    t = np.concatenate([np.zeros(10), np.arange(8), np.arange(8)[::-1], np.zeros(20)]).astype(np.float32)
    assert peaks(t, np.zeros_like(t), (3, 1.4, 6, 9.0, 0.2)) == [17]
