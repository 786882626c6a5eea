from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.functions import identifiers as I
from sheaf.plans import registry
from tests.oracle import TABLES, assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    assert_same(registry.QUERIES[name](spark, folder), registry.ORACLES[name], folder)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_a_row_for_each_page(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/pages.parquet").count()


def test_identifier_equals_its_sql_on_long_page_ids(spark, folder, tmp_path):
    """Numbers of five, six and ten digits; the library's own form of arXiv ids still ends at five."""
    for t in TABLES:
        if t != "pages":
            Path(f"{tmp_path}/{t}.parquet").symlink_to(f"{folder}/{t}.parquet")
    duckdb.sql(
        f"COPY (SELECT a + b AS page_id, '' AS url, '' AS html FROM (SELECT unnest([0, 89990, 99990, 6000000000]) AS a), range(20) r(b)) TO '{tmp_path}/pages.parquet'"
    )
    assert_same(registry.QUERIES["identifier"](spark, str(tmp_path)), registry.ORACLES["identifier"], str(tmp_path))
    given = spark.createDataFrame([("arXiv:2101.99999",), ("arXiv:2101.100001",)], "v string")
    assert [r["v"] for r in given.select(I.identifier(F.col("v"))["value"].alias("v")).collect()] == ["2101.99999", None]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
