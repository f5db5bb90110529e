"""Tables as files: line numbers over splits, strict readers, ordered texts, region and length layouts, growing frequencies."""

import os

import pytest
from pyspark.sql import functions as F

from siglake.operators import frequency as Q
from siglake.sources import layout, tables
from siglake.sources.lines import numbered_lines, write_ordered
from siglake.streaming import merge


def parts(path):
    return [open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-")]


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    want = []
    for k, n in enumerate((5000, 1, 0, 777)):
        rows = [f"{k}-{i}-{'x' * (i % 50)}" for i in range(n)]
        (tmp_path / f"f{k}.txt").write_text("".join(r + "\n" for r in rows))
        want += [(r, i + 1, rows[0]) for i, r in enumerate(rows)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() > 4
        got = sorted(lines.collect(), key=lambda r: r.row_no)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.value, r.line_no, r.header) for r in got] == want and [r.row_no for r in got] == list(range(len(want)))


ROWS = [("chr1", "+", 5, 9, "r1", -3.25, -100.0, -96.75, 1, 2, "ACGCGT"), ("chr1", "-", 5, 9, "r2", 4.0, -90.0, -94.0, 1, 1, "OTHER"), ("chr2", "+", 1, 1, "r3", 2.4, 0.0, 0.0, 1, 1, "ACG")]


def write(path, version, lines):
    path.write_text(tables.HEADERS[version] + "\n" + "".join(line + "\n" for line in lines))


@pytest.mark.parametrize("version", [0, 1, 2, 3])
def test_calls_in_every_variant(spark, tmp_path, version):
    write(tmp_path / "a.tsv", version, ["\t".join(str(v) for k, v in enumerate(r) if version > 1 or k != 1) for r in ROWS])
    got = tables.read_calls(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [tuple(r)[:-1] for r in got] == [r if version > 1 else (r[0], None, *r[2:]) for r in ROWS]
    first = Q.site_frequency(tables.read_calls(spark, str(tmp_path))).collect()
    assert [(r.num_motifs_in_group, r.called_sites, r.group_sequence) for r in first] == [(2, 3, "ACGCGT")]


def test_files_of_both_variants_in_one_folder(spark, tmp_path):
    write(tmp_path / "a.tsv", 3, ["\t".join(map(str, ROWS[1]))])
    write(tmp_path / "b.tsv", 0, ["\t".join(str(v) for k, v in enumerate(ROWS[0]) if k != 1)])
    (r,) = Q.site_frequency(tables.read_calls(spark, str(tmp_path))).collect()
    assert (r.num_motifs_in_group, r.called_sites, r.group_sequence) == (1, 3, "OTHER")  # the first file's


GOOD = "chr1\t+\t5\t9\tr1\t3\t-1\t-1\t1\t2\tACG"


@pytest.mark.parametrize(
    ("line", "message"),
    [
        (GOOD + "\textra", "more columns than expected in line 3"),
        ("\t".join(GOOD.split("\t")[:-1]), "too few columns in line 3"),
        (GOOD.replace("\t5\t", "\t-5\t"), "negative coordinates in line 3"),
        (GOOD.replace("\t2\tACG", "\t-2\tACG"), "negative number of motifs in line 3"),
        ("", "too few columns in line 3"),
    ],
)
def test_bad_calls_end_the_job(spark, tmp_path, line, message):
    write(tmp_path / "a.tsv", 3, [GOOD, line, GOOD])
    with pytest.raises(Exception, match=message):
        tables.read_calls(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match=message):
        Q.site_frequency(tables.read_calls(spark, str(tmp_path))).collect()


def test_bad_header_and_no_numbers(spark, tmp_path):
    write(tmp_path / "a.tsv", 3, [GOOD.replace("\t5\t", "\t5x\t").replace("\t3\t", "\tabc\t")])
    (r,) = tables.read_calls(spark, str(tmp_path)).collect()
    assert (r.start, r.log_lik_ratio) == (5, 0.0)
    (tmp_path / "b.tsv").write_text("chromosome\tstart\n" + GOOD + "\n")
    with pytest.raises(Exception, match="incorrect header in line 1"):
        tables.read_calls(spark, f"{tmp_path}/b.tsv").collect()
    with pytest.raises(Exception, match="too few columns in line 1"):  # goes on with the header of a.tsv
        tables.read_calls(spark, str(tmp_path)).collect()


def test_empty_files(spark, tmp_path):
    write(tmp_path / "a.tsv", 3, [])
    (tmp_path / "b.tsv").write_text("")
    assert tables.read_calls(spark, str(tmp_path)).collect() == []


def test_ordered_text(spark, tmp_path):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "concat('line', (id * 7919) % 1000) as line").repartition(7)
    write_ordered(d, ["k"], f"{tmp_path}/out", "the header", partitions=4)
    texts = parts(f"{tmp_path}/out")
    assert len(texts) == 4 and all(texts) and "".join(texts) == "the header\n" + "".join(f"line{k}\n" for k in range(1000))


def test_merged_files_are_one_ordered_text(spark, tmp_path):
    names = [c.split()[0] for c in tables.FREQ.split(", ")]
    rows = [[("chr2", 10, 12, 1, 4, 1, 0.25, "A"), ("chr1", 5, 5, 1, 3, 3, 1.0, "B")], [("chr2", 10, 12, 1, 2, 2, 1.0, "A"), ("chr1", 100, 100, 1, 1, 0, 0.0, "C")]]
    for k, r in enumerate(rows):
        tables.write_frequencies(spark.createDataFrame(r, names), f"{tmp_path}/f{k}", tables.FREQ_HEADERS[1 - k])
    tables.merge_frequency_files(spark, [f"{tmp_path}/f0", f"{tmp_path}/f1"], f"{tmp_path}/m", partitions=3)
    want = [tables.FREQ_HEADERS[0], "chr1\t5\t5\t1\t3\t3\t1.000\tB", "chr1\t100\t100\t1\t1\t0\t0.000\tC", "chr2\t10\t12\t1\t6\t3\t0.500\tA"]
    assert "".join(parts(f"{tmp_path}/m")).splitlines() == want


def test_sequences_must_agree(spark):
    names = [c.split()[0] for c in tables.FREQ.split(", ")]
    files = [spark.createDataFrame([("chr1", 5, 5, 1, 3, 3, 1.0, s)], names) for s in "AB"]
    with pytest.raises(Exception, match="differ"):
        Q.merge_frequencies(files).collect()


def test_region_layout(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('c', id % 3) as contig", "(id * 7919) % 100000 as pos", "(id * 7919) % 100000 + CASE WHEN id % 100 = 0 THEN 60000 ELSE id % 500 END as ref_end", "id")
    layout.write_by_region(rows, f"{tmp_path}/r", finest=10)
    for start, end in ((0, 1), (5000, 9000), (8191, 8193), (99_999, 200_000), (150_000, 150_001), (70, 70)):
        got = layout.read_region(spark, f"{tmp_path}/r", "c1", start, end, finest=10)
        want = rows.where(f"contig = 'c1' and pos < {end} and ref_end > {start}")
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bin#" in plan.split("PartitionFilters")[1].split("]")[0]
    read = layout.read_region(spark, f"{tmp_path}/r", "c1", 5000, 9000, finest=10)
    files = read.select(F.input_file_name().alias("f")).distinct().count()
    assert files < 0.1 * spark.read.parquet(f"{tmp_path}/r").select(F.input_file_name()).distinct().count()


def test_length_groups(spark, tmp_path):
    reads = spark.createDataFrame([("a", "A" * 10), ("b", "C" * 1500), ("c", "G" * 1600), ("d", "T" * 3000), ("d", "T" * 3000), ("e", "")], "read_id string, seq string")

    def groups(**options):
        return sorted((r.file, r.read_id) for r in layout.grouped_by_length(reads, **options).collect())

    assert groups() == [("0k_1k", "a"), ("0k_1k", "e"), ("1k_2k", "b"), ("1k_2k", "c"), ("3k_4k", "d")]
    assert groups(mode="limit", high=3000) == [("0k_1k", "a"), ("0k_1k", "e"), ("1k_2k", "b"), ("1k_2k", "c")]
    assert groups(mode="range", low=1000, high=3000) == [("1k_3k", "b"), ("1k_3k", "c"), ("1k_3k", "d")]
    assert groups(mode="accumulate") == [("0k_1k", "a"), ("0k_1k", "e"), *[("0k_3k", x) for x in "abce"]]
    with pytest.raises(ValueError, match="2000"):
        layout.grouped_by_length(reads, mode="limit", high=2000)
    layout.write_by_length(reads, f"{tmp_path}/x")
    assert sorted(os.path.basename(f) for f in os.listdir(f"{tmp_path}/x") if f.startswith("file=")) == ["file=0k_1k", "file=1k_2k", "file=3k_4k"]
    assert "".join(parts(f"{tmp_path}/x/file=3k_4k")) == ">d\n" + "T" * 3000 + "\n"


@pytest.mark.parametrize("budget", [0, 1, 999, 5000, 10**9])
def test_take_bases(spark, budget):
    rows = [(k, "A" * (k * 37 % 91)) for k in range(300)]
    got = layout.take_bases(spark.createDataFrame(rows, "ord long, seq string").repartition(6), budget)
    want, spent = [], 0
    for k, s in rows:
        spent += len(s)
        if spent > budget:
            break
        want.append(k)
    assert sorted(r.ord for r in got.collect()) == want


CALLS = "chromosome string, start long, end long, log_lik_ratio double, num_motifs long, sequence string, row_no long"


def test_growing_frequency(spark, tmp_path):
    batches = [
        [("chr1", 5, 5, 3.0, 1, "ACG", 7), ("chr1", 5, 5, -3.0, 1, "TCG", 3), ("chr1", 5, 5, 1.0, 1, "low", 1)],
        [("chr1", 5, 5, 9.0, 2, "GCG", 0), ("chr2", merge.RANGE + 1, merge.RANGE + 1, 9.0, 1, "X", 1)],
        [],
    ]
    state = f"{tmp_path}/s"
    for k, rows in [*enumerate(batches), (1, batches[1]), (0, batches[0])]:  # two are run again
        merge.add_batch(spark.createDataFrame(rows, CALLS), k, state)
    want = [("chr1", 5, 5, 1, 4, 3, 0.75, "TCG"), ("chr2", merge.RANGE + 1, merge.RANGE + 1, 1, 1, 1, 1.0, "X")]
    assert sorted(map(tuple, merge.merged_frequency(spark, state).collect())) == want
    region = merge.merged_frequency(spark, state, "chr2", merge.RANGE, merge.RANGE + 2)
    assert [tuple(r) for r in region.collect()] == want[1:]
    merge.compact(spark, state, f"{tmp_path}/t", 1)
    assert sorted(map(tuple, merge.merged_frequency(spark, f"{tmp_path}/t").collect())) == want
    merge.add_batch(spark.createDataFrame([("chr1", 5, 5, -9.0, 4, "late", 0)], CALLS), 2, f"{tmp_path}/t")
    assert sorted(map(tuple, merge.merged_frequency(spark, f"{tmp_path}/t").collect()))[0] == ("chr1", 5, 5, 1, 8, 3, 0.375, "TCG")
