"""Every query of the signal engine against DuckDB on the small tables."""

import pytest

from siglake.plans.registry import ORACLES, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), sf, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_kernels_run(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
