"""op9_pii: what building its long expression leaves in the driver's heap."""

import gc

import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.pii import pseudonymize  # noqa: E402

BUILD = """
import gc
from pyspark.sql import SparkSession
from siglake.llm.pii import pseudonymize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
def held():
    gc.collect()
    for _ in range(3):
        spark._jvm.System.gc()
    r = spark._jvm.Runtime.getRuntime()
    return (r.totalMemory() - r.freeMemory()) / 1e6
docs = spark.sql("SELECT 1 AS doc_id, transform(array('a'), x -> concat(x, 'b'))[0] AS text")
docs.collect()
before = held()
pseudonymize(docs, key="k").schema
gc.collect()
print("grown", held() - before)
spark.stop()
"""


def test_building_leaves_the_heap_small():
    out = subprocess.run([sys.executable, "-c", BUILD], capture_output=True, cwd=Path(__file__).parents[2], text=True, timeout=300, check=True).stdout
    assert float(out.split("grown")[1]) < 40


def test_settings_of_the_parser_stay(spark):
    keys = ("spark.sql.parser.manageParserCaches", "spark.sql.parser.parserDfaCacheFlushThreshold")
    before = [spark.conf.get(k) for k in keys]
    pseudonymize(spark.range(1).selectExpr("'a' as text"), key="k")
    assert [spark.conf.get(k) for k in keys] == before
