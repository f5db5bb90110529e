"""Output lines on small rows with known answers."""

from siglake.operators import emit as O


def test_signal_paths(spark):
    rows = [("f", 0, 3, 10, 15, False), ("f", 1, 3, 15, 20, False), ("f", 2, 4, 22, 30, False), ("f", 3, 7, 30, 33, False), ("r", 0, 5, 20, 26, True), ("r", 1, 6, 10, 20, True), ("r", 2, 8, 4, 9, True)]
    d = spark.createDataFrame(rows, "k string, i long, ref_pos long, start long, stop long, reverse boolean")
    assert sorted(map(tuple, O.signal_paths(d, "k").collect())) == [("f", 10, 33, 3, 8, 3, "10,2I8,2D3,"), ("r", 4, 26, 5, 9, 3, "5,1D1I10,6,")]
    # RNA runs from its end: the strands change places, and so do the ends
    rna = {r.k: tuple(r)[1:] for r in O.signal_paths(d.selectExpr("k", "i", "ref_pos", "start", "stop", "not reverse as reverse"), "k", rna=True).collect()}
    assert rna == {"f": (10, 33, 8, 3, 3, "10,2I8,2D3,"), "r": (4, 26, 9, 5, 3, "5,1D1I10,6,")}


def test_event_cigars(spark):
    rows = [("a", 0, 2, 5), ("a", 1, 3, 6), ("a", 2, 4, 6), ("a", 3, 5, 9), ("a", 4, 6, 10), ("b", 0, 7, 3), ("b", 1, 6, 4), ("c", 0, 0, 1)]
    out = O.event_cigars(spark.createDataFrame(rows, "k string, i long, event long, ref_pos long"), "k").collect()
    assert sorted(map(tuple, out)) == [("a", "2S2M1I2D2M", 1), ("b", "7S2M", -1), ("c", "1M", -1)]


def test_resquiggle(spark):
    mapped = spark.createDataFrame([("a", 1, 4, 9), ("a", 2, 9, 12), ("a", 5, 14, 20)], "k string, kmer long, start long, stop long")
    sizes = spark.createDataFrame([("a", 7), ("none", 2)], "k string, n_kmers long")
    kmers = O.resquiggle_kmers(mapped, sizes, "k")
    assert sorted(r.line for r in O.resquiggle_rows(kmers, "k").collect()) == ["a\t0\t.\t.", "a\t1\t4\t9", "a\t2\t9\t12", "a\t3\t.\t.", "a\t4\t.\t.", "a\t5\t14\t20", "a\t6\t.\t.", "none\t0\t.\t.", "none\t1\t.\t."]
    assert list(map(tuple, O.resquiggle_paths(kmers, "k").collect())) == [("a", 4, 20, 1, 6, 3, "5,3,2D2I6,")]
    # RNA: the last k-mer is read first
    turned = spark.createDataFrame([("a", 5, 4, 9), ("a", 4, 9, 12), ("a", 1, 14, 20)], "k string, kmer long, start long, stop long")
    assert list(map(tuple, O.resquiggle_paths(O.resquiggle_kmers(turned, sizes, "k", rna=True), "k", rna=True).collect())) == [("a", 4, 20, 6, 1, 3, "5,3,2D2I6,")]


def test_tables_end_and_round_as_they_should(spark):
    event = spark.range(1).selectExpr("'c' as contig", "5 as position", "'ACGTA' as reference_kmer", "'r' as read_name", "3 as event_index", "80.125D as level", "1.0625D as stdv", "0.00225D as duration", "'NNNNN' as model_kmer", "0D as model_mean", "0D as model_stdv", "1D as var", "7 as start_idx", "9 as end_idx")
    assert O.event_rows(event, True).first().line == "c\t5\tACGTA\tr\tt\t3\t80.12\t1.062\t0.00225\tNNNNN\t0.00\t0.00\tinf\t7\t9"
    position = spark.range(1).selectExpr("'c' as contig", "5 as ref_pos", "'ACGTA' as ref_kmer", "'r' as read_name", "double('nan') as event_level_mean", "double('nan') as event_stdv", "double('nan') as event_duration", "7 as start_idx", "9 as end_idx")
    assert O.m6anet_rows(position).first().line == "c\t5\tACGTA\tr\tnan\tnan\tnan\t"
    assert O.m6anet_rows(position, True).first().line == "c\t5\tACGTA\tr\tnan\tnan\tnan\t\t7\t9"
    assert len(O.EVENTALIGN) == 13 and len(O.M6ANET) == 7 and len(O.SUMMARY) == 14
