"""Small tables as files: summaries, bedMethyl, read indexes, comparisons, frequencies; runs known by their headers."""

import os

import pytest

from siglake.functions import signal as S
from siglake.operators import emit as O
from siglake.operators import frequency as Q
from siglake.sources import tables


def text(path):
    return "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_listed_summaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("filename\tread_id\tx\nf1\tr1\t0\n")
    (tmp_path / "b.txt").write_text("read_id\tfilename_fast5\nr2\tf2\nr3\tf2\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.txt\n{tmp_path}/b.txt\n")
    assert sorted(map(tuple, tables.read_listed_summaries(spark, f"{tmp_path}/list").collect())) == [("r1", "f1"), ("r2", "f2"), ("r3", "f2")]
    (tmp_path / "c.txt").write_text("read_id\tname\nr2\tf2\n")
    with pytest.raises(ValueError, match="c.txt: a summary needs"):
        tables.read_summary(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/c.txt"])


BED = "chr1 {} {} m 5 {} {} {} 0,0,0 {} {}"


def test_bedmethyl(spark, tmp_path):
    lines = [BED.format(10, 11, "+", 10, 11, 7, 50.0), BED.format(11, 12, "-", 11, 12, 3, "33.4").replace(" ", "\t"), "  " + BED.format(20, 21, "+", 20, 21, 4, 0).replace(" ", "   ") + "\tmore"]
    (tmp_path / "a.bed").write_text("\n".join(lines) + "\n")
    sites = Q.accumulate_bedmethyl(tables.read_bedmethyl(spark, f"{tmp_path}/a.bed"))
    assert sorted(map(tuple, sites.collect())) == [("chr1", 10, 10, 10.0, 4), ("chr1", 20, 20, 4.0, 0)]
    for bad in ("chr1 10", BED.format("x", 11, "+", 10, 11, 7, 50.0), BED.format(10, 11, "+", 10, 11, "x", 50.0)):
        (tmp_path / "b.bed").write_text(lines[0] + "\n" + bad + "\n")
        with pytest.raises(Exception, match="no bedMethyl in line 2"):
            tables.read_bedmethyl(spark, f"{tmp_path}/b.bed").collect()


def test_indexes(spark, tmp_path):
    (tmp_path / "a").write_text("r9\t/a\nr1\t/a\nodd line\nr2\t/a\textra\n")
    (tmp_path / "b").write_text("r5\t/b\nr1\t/b\n")
    tables.merge_read_indexes(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/m")
    assert text(f"{tmp_path}/m") == "r1\t/b\nr5\t/b\nr9\t/a\n"


NAMES = [c.split()[0] for c in tables.FREQ.split(", ")]


def test_comparison(spark, tmp_path):
    one = spark.createDataFrame([("chr2", 5, 5, 1, 8, 1, 0.125, "A"), ("chr1", 7, 7, 1, 3, 1, 1 / 3, "B"), ("chr1", 8, 8, 2, 3, 1, 1 / 3, "B"), ("chr1", 9, 9, 1, 0, 0, 0.0, "B")], NAMES)
    two = spark.createDataFrame([("chr2", 5, 5, 1, 4, 4, 1.0, "A"), ("chr1", 7, 7, 1, 6, 1, 1 / 6, "B"), ("chr1", 8, 8, 2, 3, 1, 1 / 3, "B"), ("chr1", 9, 9, 1, 2, 0, 0.0, "B")], NAMES)
    tables.write_compared(Q.compare_frequencies(one, two), f"{tmp_path}/c", partitions=2)
    assert text(f"{tmp_path}/c").splitlines() == ["key\tdepth_1\tfrequency_1\tdepth_2\tfrequency_2", "chr1:7-7\t3\t0.3333\t6\t0.1667", "chr2:5-5\t8\t0.1250\t4\t1.0000"]


FREQ = "chr1\t5\t6\t1\t4\t1\t0.250\tACG"


def test_frequencies_end_at_an_empty_line(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(f"{tables.FREQ_HEADERS[0]}\n{FREQ}\n\nnot read\n")
    (tmp_path / "b.tsv").write_text(f"{tables.FREQ_HEADERS[1]}\n{FREQ}\n{FREQ}\n")
    assert [tuple(r) for r in tables.read_frequencies(spark, str(tmp_path)).collect()] == [("chr1", 5, 6, 1, 4, 1, 0.25, "ACG")] * 3
    assert tables.frequency_header(spark, str(tmp_path)) == tables.FREQ_HEADERS[1]


@pytest.mark.parametrize(("line", "message"), [(FREQ + "\tx", "more columns than expected in line 3"), (FREQ[:-4], "too few columns in line 3"), (FREQ.replace("\t5\t", "\t-5\t"), "negative or no coordinates in line 3"), (FREQ.replace("\t1\t4", "\t-1\t4"), "negative or no number of motifs in line 3")])
def test_bad_frequencies(spark, tmp_path, line, message):
    (tmp_path / "a.tsv").write_text(f"{tables.FREQ_HEADERS[0]}\n{FREQ}\n{line}\n")
    with pytest.raises(Exception, match=message):
        tables.read_frequencies(spark, f"{tmp_path}/a.tsv").collect()


def test_detected_runs(spark):
    rows = [("a", 0, "rna", "sqk-rna004"), ("a", 1, "rna", "sqk-rna004"), ("b", 0, "genomic_dna", "sqk-lsk114"), ("b", 1, "rna", None), ("c", 0, None, None), ("c", 1, "rna", "sqk-lsk114"), ("d", 0, "odd", "sqk-lsk109")]
    d = spark.createDataFrame(rows, "file string, read_group long, experiment_type string, sequencing_kit string")
    got = {r.file: (r.rna, r.pore, r.warnings) for r in S.detect_run(d).collect()}
    assert got == {"a": (True, "rna004", []), "b": (False, "r10", ["experiment types differ", "sequencing kits differ"]), "c": (False, "r9", ["no experiment type", "no sequencing kit"]), "d": (False, "r9", ["unknown experiment type"])}


def test_event_lines_of_one_read(spark):
    """Pairs, signal and model to lines, by hand: a run of two, then one event in state B."""
    rows = [("r", 0, "c", 7, "ACG", "r", 3, "ACG", "M", 0, 2, 10.0, 1.0), ("r", 1, "c", 7, "ACG", "r", 4, "CGT", "E", 2, 2, 20.0, 1.0), ("r", 2, "c", 8, "CGT", "r", 5, "CGT", "B", 5, 1, 30.0, 2.0)]
    d = spark.createDataFrame(rows, "read_id string, i long, contig string, ref_pos long, ref_kmer string, read_name string, event_index long, model_kmer string, hmm_state string, start long, length long, mean double, stdv double")
    signals = spark.createDataFrame([("r", [1, 3, 5, 7, 9, 11], 2.0)], "read_id string, samples array<int>, sample_rate double")
    scalings = spark.createDataFrame([("r", 1.0, 2.0, 4.0)], "read_id string, shift double, scale double, var double")
    model = spark.createDataFrame([("ACG", 1.0, 0.5), ("CGT", 9.0, 0.25)], "model_kmer string, model_mean double, model_stdv double")
    lines = lambda **o: [r.line for r in sorted(O.event_lines(d, signals, scalings, model, **o).collect(), key=lambda r: r.island)]
    assert lines(collapse=True, scale_events=True, signal_index=True, samples=True) == [
        "c\t7\tACG\tr\tt\t3\t1.50\t2.236\t2.00000\tACG\t1.00\t0.50\t0.50\t0\t4\t0,1,2,3",
        "c\t8\tCGT\tr\tt\t5\t14.50\t2.000\t0.50000\tCGT\t0.00\t0.00\tinf\t5\t6\t5",
    ]
    assert lines() == [
        "c\t7\tACG\tr\tt\t3\t10.00\t1.000\t1.00000\tACG\t3.00\t2.00\t1.75",
        "c\t7\tACG\tr\tt\t4\t20.00\t1.000\t1.00000\tCGT\t19.00\t1.00\t0.50",
        "c\t8\tCGT\tr\tt\t5\t30.00\t2.000\t0.50000\tCGT\t0.00\t0.00\tinf",
    ]
