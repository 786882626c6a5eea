"""The tables of a data folder, read by Spark so that any path that Spark can open works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
