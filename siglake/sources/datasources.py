"""Spark data sources: fastx, slow5, blow5 (read and write), bam. One partition per file; register(spark) makes them known.

Files must be where every executor can open them. Filters on read_id, contig
and position are taken over by the readers, so records that can't match are not
turned into rows."""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan, WriterCommitMessage

from siglake.sources import formats

SIGNAL = "read_id string, read_group int, digitisation double, offset double, range double, sampling_rate double, len_raw_signal long, raw_signal array<short>, aux map<string,string>"


class Files(DataSourceReader):
    def __init__(self, options, columns, rows):
        path = options.get("path", "")
        self.paths = sorted(p for one in path.split(",") for p in (glob.glob(f"{one}/*") if os.path.isdir(one) else glob.glob(one)))
        if not self.paths:
            raise FileNotFoundError(path)
        self.columns, self.rows, self.tests = columns, rows, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo):
                self.tests.append((name, "=", f.value))
            elif isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif isinstance(f, LessThan):
                self.tests.append((name, "<", f.value))
            elif isinstance(f, GreaterThanOrEqual):
                self.tests.append((name, ">=", f.value))
            yield f  # Spark checks again, so a filter that is applied here in part is right

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def keeps(self, row) -> bool:
        for name, op, value in self.tests:
            v = row.get(name)
            if name in row and (v is None or (op == "=" and v != value) or (op == "in" and v not in value) or (op == "<" and not v < value) or (op == ">=" and not v >= value)):
                return False
        return True

    def read(self, partition):
        for row in self.rows(partition.value):
            if self.keeps(row):
                yield tuple(row[c] for c in self.columns)


def _source(kind, ddl, rows):
    columns = [c.split()[0] for c in ddl.replace("struct<op:string,len:int>", "x").replace("map<string,string>", "m").split(", ")]

    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return ddl

        def reader(self, schema):
            return Files(self.options, columns, rows)

    Source.__name__ = kind.title()
    return Source


def _fastx(path):
    for ordinal, name, comment, seq in formats.read_fastx(path):
        yield {"read_id": name, "seq": seq, "comment": comment, "ord": ordinal}


Fastx = _source("fastx", "read_id string, seq string, comment string, ord long", _fastx)
Slow5 = _source("slow5", SIGNAL, formats.read_slow5)
Bam = _source("bam", "read_index long, qname string, flag int, contig string, pos int, mapq int, cigar array<struct<op:string,len:int>>, ref_end int, nm int, seq string", formats.read_bam)


class Blow5Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.record, self.signal = options["path"], int(options.get("record", "1")), int(options.get("signal", "1"))

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        path = f"{self.path}/part-{uuid.uuid4().hex}.blow5"
        with open(path + ".tmp", "wb") as f:
            f.write(formats.blow5_header(self.record, self.signal, {}))
            for row in rows:
                f.write(formats.blow5_record(row.asDict(), self.record, self.signal))
            f.write(formats.END)
        message = WriterCommitMessage()
        message.path = path
        return message

    def commit(self, messages):
        for m in messages:
            if m:
                os.rename(m.path + ".tmp", m.path)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")


class Blow5(_source("blow5", SIGNAL, formats.read_blow5)):
    def writer(self, schema, overwrite):
        return Blow5Writer(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Fastx, Slow5, Blow5, Bam):
        spark.dataSource.register(source)
