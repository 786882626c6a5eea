"""Working tables and files in the folder that driver and executors share."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from sheaf.sources.workspace import workspace, written

__all__ = ["file_system", "remove", "workspace", "written"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working folder whose table nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system and path of a folder URI (file, hdfs, s3, gs), for executors that write files themselves."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
