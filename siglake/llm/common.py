"""Helpers shared by the training-data operators.

``materialize`` is the one way in which an operator cuts its lineage: the rows
go to Parquet in the folder that the cluster shares (``spark.checkpoint.dir``)
and are read again, so a lost executor costs a re-read and never a rerun of
what stands above.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A broadcast side may have this many rows at most; every caller states a row width of under 200 bytes.
BROADCAST_ROWS = 100_000

WORD_GAP = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where Spark runs in one process and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = d.get()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siglake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siglake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.held_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting: beyond max_rows the join stays a shuffled one, which AQE splits where it is skewed. Give it a materialized df."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextmanager
def forgetful_parser(spark: SparkSession):
    """Inside, Spark's parser drops the states it has learnt once they are many. It would keep them in the driver's heap for good, 70 MB of them for the longest expression here. Settings are put back."""
    wanted = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1000"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def words_sql(text: str, gap: str) -> str:
    """Spark SQL: the array of words of text, null as no words."""
    return f"filter(split(coalesce({text}, ''), r'{gap}'), w -> w <> '')"


def lower_sql(text: str) -> str:
    """Lower-cases A-Z alone, as lower() also changes other letters."""
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with i, each row's place from 0 in its group by order, nulls first; a group may hold any share of all rows.

    Rows are dealt into ranges, so a large group lies in many of them. A row's place is its place in its range, from the first row of its group there, and the number of the group's rows in the ranges before, of which there is one row for each group and range. Rows that are equal in order are numbered in any order."""
    by = [F.col(c).asc_nulls_first() for c in group + order]
    held = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), name)
    held = held.withColumn("range", F.shiftright("at", 33))
    per = held.groupBy(*group, "range").agg(F.min("at").alias("least"), F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per = materialize(per.select(*[F.col(c).alias(f"g_{c}") for c in group], F.col("range").alias("g_range"), (F.coalesce(earlier, F.lit(0)) - F.col("least")).alias("shift")), f"{name}-ranges")
    same = all_of([F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group] + [F.col("range") == F.col("g_range")])
    return held.join(checked_broadcast(per), same).select(*df.columns, (F.col("at") + F.col("shift")).alias("i"))


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left joined to right, in which a key stands once. hot: the keys of at least a fixed share of left's rows, so of a number that the share bounds; their rows of right are broadcast and left's rows with them stay where they are."""
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(few, key).unionByName(left.join(hot, key, "left_anti").join(right, key))
