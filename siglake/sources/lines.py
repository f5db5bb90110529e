"""Lines of text files with their numbers, and texts written in order over many part files.

Spark reads a file in splits, and a split's lines in order within one task. A
line's number is the number of lines in the splits before and its place in its
own: one count per split and a running sum over splits, which are as many as
the tasks that read, so no window runs over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglake.sources.shared import checked_broadcast, shared_folder


def numbered_lines(spark: SparkSession, path: str | list[str], headers: list[str] | None = None) -> DataFrame:
    """value, file, line_no (from 1 in its file), row_no (from 0 over all files in the order of their paths), header (the file's first line), ended (whether the line, or one before it in the file, is empty).

    headers: the first lines that there may be; a file that starts with none of them goes on with the header of the file before, as part files of one text do. Both passes are of one DataFrame, whose files are fixed when it is made; its splits depend on the number of cores too, so a line whose split or place is not as it was counted ends the job. The counts are made at once and written, as they are read twice. Lines end with \\n, \\r\\n or \\r; an empty last line is none."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"), F.min_by("value", "at").alias("first"), F.min(F.when(F.col("value") == "", F.col("at"))).alias("blank"))
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_order = Window.orderBy("file", "block")  # a row per split
    header = F.first("first").over(in_file)
    splits = splits.select("file", "block", "least", earlier(in_file).alias("in_file"), earlier(in_order).alias("before"), header.alias("header"), (F.col("blank") - F.col("least")).alias("blank"), "n")
    splits = splits.withColumn("blank", F.min(F.col("in_file") + F.col("blank") + 1).over(Window.partitionBy("file")))
    if headers:
        splits = splits.withColumn("header", F.coalesce(F.last(F.when(F.col("header").isin(*headers), F.col("header")), True).over(in_order), "header"))
    path = shared_folder(spark, "splits")
    splits.write.parquet(path)
    splits = spark.read.schema(splits.schema).parquet(path)
    place = F.col("at") - F.col("least")
    moved = F.raise_error(F.lit("the splits of the input changed between its two passes; keep the number of cores, or set spark.sql.files.minPartitionNum"))
    place = F.when(F.coalesce((place >= 0) & (place < F.col("n")), F.lit(False)), place).otherwise(moved.cast("bigint"))
    ended = F.coalesce(F.col("in_file") + place + 1 >= F.col("blank"), F.lit(False))
    return lines.join(checked_broadcast(splits), ["file", "block"], "left").select("value", "file", (F.col("in_file") + place + 1).alias("line_no"), (F.col("before") + place).alias("row_no"), "header", ended.alias("ended"))


def write_ordered(lines: DataFrame, order: list[str], path: str, header: Column | str | None = None, partitions: int | None = None) -> None:
    """The column line of lines as text, whose part files, one after the other by name, are one ordered text with the header first and once.

    Rows are dealt into ranges of order and sorted there, so no task sees more than its range. header: a text."""
    rows = lines.select(F.lit(1).alias("kind"), *order, "line")
    if header is not None:
        first = lines.sparkSession.range(1).select(F.lit(0).alias("kind"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(header).alias("line"))
        rows = first.unionByName(rows)
    by = [F.col(c).asc_nulls_first() for c in ("kind", *order)]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).select("line").write.text(path)
