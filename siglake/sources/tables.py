"""Tab-separated tables: calls, frequencies, regions, summaries, read indexes; their readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.operators.frequency import formatted, merge_frequencies
from siglake.operators.reads import last_paths
from siglake.sources.lines import numbered_lines, write_ordered

CALLS = "chromosome string, strand string, start int, end int, read_name string, log_lik_ratio double, log_lik_methylated double, log_lik_unmethylated double, num_calling_strands int, num_motifs int, sequence string"
#: The first lines of tables of calls.
HEADERS = [
    "chromosome\tstart\tend\tread_name\tlog_lik_ratio\tlog_lik_methylated\tlog_lik_unmethylated\tnum_calling_strands\tnum_cpgs\tsequence",
    "chromosome\tstart\tend\tread_name\tlog_lik_ratio\tlog_lik_methylated\tlog_lik_unmethylated\tnum_calling_strands\tnum_motifs\tsequence",
    "chromosome\tstrand\tstart\tend\tread_name\tlog_lik_ratio\tlog_lik_methylated\tlog_lik_unmethylated\tnum_calling_strands\tnum_cpgs\tsequence",
    "chromosome\tstrand\tstart\tend\tread_name\tlog_lik_ratio\tlog_lik_methylated\tlog_lik_unmethylated\tnum_calling_strands\tnum_motifs\tsequence",
]
FREQ_HEADERS = [
    "chromosome\tstart\tend\tnum_cpgs_in_group\tcalled_sites\tcalled_sites_methylated\tmethylated_frequency\tgroup_sequence",
    "chromosome\tstart\tend\tnum_motifs_in_group\tcalled_sites\tcalled_sites_methylated\tmethylated_frequency\tgroup_sequence",
]
FREQ = "chromosome string, start int, end int, num_motifs_in_group int, called_sites long, called_sites_methylated long, methylated_frequency double, group_sequence string"


def _tsv(spark: SparkSession, path, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, mode="FAILFAST", enforceSchema=True)


def read_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Calls of one or many files, with row_no, their order over all files.

    Every file starts with one of the four headers, with or without a strand, which says how many columns its lines have; HEADERS lists them. Part files of one text have the header of the first. Fields are separated by one tab or more; those of numbers are read as far as they are numbers, like C's atoi. A wrong header, a line with fewer or more columns, and negative coordinates or counts end the job with the number of the line."""
    lines = numbered_lines(spark, path, HEADERS)
    names = [c.split()[0] for c in CALLS.split(", ")]
    stranded = F.col("header").isin(*HEADERS[2:])
    fields = F.filter(F.split("value", "\t"), lambda x: x != "")
    checked = lines.select("row_no", "line_no", "value", fields.alias("f"), stranded.alias("stranded"), F.col("header").isin(*HEADERS).alias("known"))
    wrong = lambda condition, text: F.when(condition, F.raise_error(F.concat(F.lit(text), F.lit(" in line "), F.col("line_no").cast("string"))))
    n = F.size("f") - F.when(F.col("stranded"), 1).otherwise(0)
    at = lambda k: F.get("f", F.lit(k) + F.when(F.col("stranded"), 1).otherwise(0))
    whole = lambda k: F.coalesce(F.regexp_extract(at(k), r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint"), F.lit(0)).cast("int")
    real = lambda k: F.coalesce(F.regexp_extract(at(k), r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:[iI][nN][fF]|[nN][aA][nN]))", 1).try_cast("double"), F.lit(0.0))
    start, end, motifs = whole(1), whole(2), whole(8)
    fault = F.coalesce(
        wrong(~F.col("known"), "incorrect header"), wrong(n < len(names) - 1, "too few columns"), wrong(n > len(names) - 1, "more columns than expected"),
        wrong((start < 0) | (end < 0), "negative coordinates"), wrong(motifs < 0, "negative number of motifs"),
    )
    values = [F.get("f", F.lit(0)), F.when(F.col("stranded"), F.get("f", F.lit(1))), start, end, at(3), real(4), real(5), real(6), whole(7), motifs, at(9)]
    # a filter, so that no line goes unchecked, whatever is selected or filtered afterwards
    row = ~F.col("value").isin(*HEADERS) | (F.col("line_no") > 1)
    return checked.where(row & F.when(row, fault).isNull()).select(*[v.alias(c) for v, c in zip(values, names)], "row_no")


def frequency_header(spark: SparkSession, path: str) -> str:
    """The first line of a table of frequencies, of the last file in a folder; one of the two that there are."""
    last = numbered_lines(spark, path, FREQ_HEADERS).agg(F.max_by("header", "row_no").alias("header")).first()["header"]
    if last not in FREQ_HEADERS:
        raise ValueError(f"incorrect header: {last}")
    return last


def read_frequencies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frequencies of one or many files, or of a folder whose part files have one header together, in either variant. Rules as for read_calls, but that an empty line ends a file."""
    names = [c.split()[0] for c in FREQ.split(", ")]
    lines = numbered_lines(spark, path, FREQ_HEADERS)
    row = ~F.col("ended") & (~F.col("value").isin(*FREQ_HEADERS) | (F.col("line_no") > 1))
    f = lines.select("line_no", row.alias("row"), F.col("header").isin(*FREQ_HEADERS).alias("known"), F.filter(F.split("value", "\t"), lambda x: x != "").alias("f"))
    wrong = lambda condition, text: F.when(condition, F.raise_error(F.concat(F.lit(text), F.lit(" in line "), F.col("line_no").cast("string"))))
    kinds = [c.split()[1] for c in FREQ.split(", ")]
    values = [F.get("f", F.lit(k)).try_cast(t) for k, t in enumerate(kinds)]
    fault = F.coalesce(
        wrong(~F.col("known"), "incorrect header"), wrong(F.size("f") < len(names), "too few columns"), wrong(F.size("f") > len(names), "more columns than expected"), wrong(F.coalesce(values[1] < 0, F.lit(True)) | F.coalesce(values[2] < 0, F.lit(True)), "negative or no coordinates"),
        wrong(F.coalesce(values[3] < 0, F.lit(True)), "negative or no number of motifs"), wrong(values[4].isNull() | values[5].isNull() | values[6].isNull(), "no number"),
    )
    # filters may run in any order, so what raises asks itself whether the line is a row
    return f.where(F.col("row") & F.when(F.col("row"), fault).isNull()).select(*[v.alias(c) for v, c in zip(values, names)])


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "contig string, r_start int, r_end int", header=False)


def read_summary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """read_id and filename of one summary or many, each with columns in an order of its own."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        d = spark.read.csv(path, sep="\t", header=True)
        name = next((c for c in ("filename", "filename_fast5") if c in d.columns), None)
        if name is None or "read_id" not in d.columns:
            raise ValueError(f"{path}: a summary needs read_id and filename or filename_fast5")
        d = d.select("read_id", F.col(name).alias("filename"))
        out = d if out is None else out.union(d)
    return out


def read_listed_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries that a file lists, a path on each line."""
    return read_summary(spark, [r.value for r in spark.read.text(path).collect() if r.value])  # a list of file names


def read_bedmethyl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chromosome, start, strand, coverage and percent of bedMethyl lines: fields 1, 2, 6, 10 and 11 between any white space. A line with fewer, or without numbers there, ends the job with its number."""
    f = numbered_lines(spark, path).select("line_no", F.split(F.trim("value"), r"\s+").alias("f"))
    get = lambda k, t: F.get("f", F.lit(k)).try_cast(t)
    numbers = [get(1, "bigint"), get(9, "double"), get(10, "double")]
    fault = F.when((F.size("f") < 11) | numbers[0].isNull() | numbers[1].isNull() | numbers[2].isNull(), F.raise_error(F.concat(F.lit("no bedMethyl in line "), F.col("line_no").cast("string"))))
    return f.where(fault.isNull()).select(get(0, "string").alias("chromosome"), numbers[0].alias("start"), get(5, "string").alias("strand"), numbers[1].alias("coverage"), numbers[2].alias("percent"))


def write_frequencies(freq: DataFrame, path: str, header: str | None = None, partitions: int | None = None) -> None:
    """Sorted by site over all part files, one header; the frequency with three digits as C prints it."""
    names = [c.split()[0] for c in FREQ.split(", ")]
    line = F.concat_ws("\t", *[formatted(F.col(c), 3) if c == "methylated_frequency" else F.col(c).cast("string") for c in names])
    write_ordered(freq.select("chromosome", "start", "end", line.alias("line")), ["chromosome", "start", "end"], path, header or FREQ_HEADERS[1], partitions)


def merge_frequency_files(spark: SparkSession, paths: list[str], path: str, partitions: int | None = None) -> None:
    """The merged table of the files, in order, with the header of the last."""
    write_frequencies(merge_frequencies([read_frequencies(spark, p) for p in paths]), path, frequency_header(spark, paths[-1]), partitions)


def write_calls(calls: DataFrame, path: str, version: int = 2, order: list[str] | None = None, partitions: int | None = None) -> None:
    """The table of calls. With order, part files are one text in that order with one header; else each has a header of its own and nothing is moved."""
    scores = [formatted(F.col(c), 2).alias(c) for c in ("log_lik_ratio", "log_lik_methylated", "log_lik_unmethylated")]
    columns = ["chromosome", *(["strand"] if version == 2 else []), "start", "end", "read_name", *scores, "num_calling_strands", F.col("num_motifs").alias("num_motifs" if version == 2 else "num_cpgs"), "sequence"]
    if order is None:
        calls.select(*columns).write.csv(path, sep="\t", header=True)
    else:
        cells = [c if isinstance(c, str) else c.cast("string") for c in columns]
        write_ordered(calls.select(*order, F.concat_ws("\t", *cells).alias("line")), order, path, HEADERS[3 if version == 2 else 0], partitions)


def read_read_index(spark: SparkSession, path: str) -> DataFrame:
    """read_id and path; lines without exactly two fields are left out."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 2)
    return fields.select(F.col("f")[0].alias("read_id"), F.col("f")[1].alias("path"))


def write_read_index(paths: DataFrame, path: str) -> None:
    """Sorted by read_id over all part files."""
    write_ordered(paths.select("read_id", F.concat_ws("\t", F.col("read_id").cast("string"), "path").alias("line")), ["read_id"], path)


def merge_read_indexes(spark: SparkSession, paths: list[str], path: str) -> None:
    """Several indexes as one; of a read in several the last one's path."""
    parts = [read_read_index(spark, p).withColumn("ord", F.lit(k)) for k, p in enumerate(paths)]
    write_read_index(last_paths(reduce(DataFrame.unionByName, parts)), path)


def compared_lines(compared: DataFrame) -> DataFrame:
    """chromosome, start, end and line of compared sites (compare_frequencies), frequencies with four digits."""
    key = F.concat_ws(":", "chromosome", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    cells = [x for k in (1, 2) for x in (F.col(f"depth_{k}").cast("bigint").cast("string"), formatted(F.col(f"frequency_{k}"), 4))]
    return compared.select("chromosome", "start", "end", F.concat_ws("\t", key, *cells).alias("line"))


def write_compared(compared: DataFrame, path: str, partitions: int | None = None) -> None:
    write_ordered(compared_lines(compared), ["chromosome", "start", "end"], path, "key\tdepth_1\tfrequency_1\tdepth_2\tfrequency_2", partitions)
