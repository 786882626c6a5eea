"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def has_workspace(spark: SparkSession) -> bool:
    """Whether there is a folder for working tables: one that the session names, or any on a local master."""
    master = spark.sparkContext.master
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or master == "local" or master.startswith("local[")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir``.

    Where that is unset on a local master (tests), a temporary folder is used and removed when Python
    ends. On a cluster without the setting this raises, as a machine's own folder would lose files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not has_workspace(spark):
            raise ValueError("spark.checkpoint.dir is not set, and a cluster needs a shared folder")
        top = tempfile.mkdtemp(prefix="sheaf-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        top = f"file://{top}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` written as Parquet and reread: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working folder whose table nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
