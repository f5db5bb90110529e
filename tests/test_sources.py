"""Formats by exact round trips, and their Spark sources."""

import gzip
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siglake.sources import datasources, formats


@given(st.lists(st.integers(-32768, 32767), max_size=300), st.integers(0, 5))
def test_signal_codecs_round_trip(values, shift):
    x = ((np.array(values, dtype=np.int64) >> shift) << shift).astype(np.int16)
    for encode, decode in formats.SIGNAL.values():
        assert (decode(encode(x)) == x).all()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_stream_vbyte_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    assert (formats.svb_decode(formats.svb_encode(v), len(v)) == v).all()


@pytest.mark.parametrize("record", [0, 1, 2])
@pytest.mark.parametrize("signal", [0, 1, 2])
def test_blow5_round_trip(spark, tmp_path, record, signal):
    datasources.register(spark)
    rows = [(f"r{i}", 0, 8192.0, 5.0, 1400.0, 4000.0, 30, [int(v) for v in np.random.default_rng(i).integers(200, 900, 30)], {}) for i in range(5)]
    df = spark.createDataFrame(rows, datasources.SIGNAL)
    df.write.format("blow5").mode("append").option("record", record).option("signal", signal).save(f"{tmp_path}/x")
    back = spark.read.format("blow5").load(f"{tmp_path}/x")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r.read_id for r in back.where("read_id = 'r3'").collect()] == ["r3"]


def test_slow5_text(spark, tmp_path):
    datasources.register(spark)
    p = tmp_path / "a.slow5"
    p.write_text("#slow5_version\t0.2.0\n#num_read_groups\t1\n@asic_id\tx\n#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*\tint32_t\n#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal\tmux\nr1\t0\t8192\t5\t1400\t4000\t3\t1,2,3\t4\nr2\t0\t8192\t5\t1400\t4000\t0\t\t.\n")
    rows = {r.read_id: r for r in spark.read.format("slow5").load(str(p)).collect()}
    assert rows["r1"].raw_signal == [1, 2, 3] and rows["r1"].aux == {"mux": "4"} and rows["r2"].aux == {}


def test_fastx(spark, tmp_path):
    datasources.register(spark)
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@r1 note\nACGT\nAC\n+\nIIII\n@I\n@r2\nGG\n+\nII\n")
    (tmp_path / "b.fasta").write_text(">r3 x y\nAC\nGT\n>r4\n")
    got = [(r.read_id, r.seq, r.comment) for r in spark.read.format("fastx").load(f"{tmp_path}/*").orderBy("read_id").collect()]
    assert got == [("r1", "ACGTAC", "note"), ("r2", "GG", ""), ("r3", "ACGT", "x y"), ("r4", "", "")]


def test_bam(spark, tmp_path):
    datasources.register(spark)
    rec = struct.pack("<iiBBHHHiiii", 0, 99, 3, 60, 0, 2, 16, 4, -1, -1, 0) + b"r1\0" + struct.pack("<2I", 3 << 4 | 0, 1 << 4 | 4) + bytes([0x12, 0x48]) + b"\xff" * 4 + b"NMC\x02" + b"XAZhi\0"
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(rec)) + rec
    with gzip.open(tmp_path / "a.bam", "wb") as f:
        f.write(data)
    (r,) = spark.read.format("bam").load(f"{tmp_path}/a.bam").collect()
    assert (r.qname, r.contig, r.pos, r.ref_end, r.flag, r.mapq, r.nm, r.seq) == ("r1", "chr1", 99, 102, 16, 60, 2, "ACGT")
    assert [tuple(o) for o in r.cigar] == [("M", 3), ("S", 1)]
