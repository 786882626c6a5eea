"""Captures as a stream: the batch projections, without those captured again, into a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.plans.captures import read_captures


def fresh(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Captures without repeats of the same URL and content within the watermark, so state stays bounded."""
    timed = captures.withColumn("_at", F.to_timestamp("fetched_at")).withColumn("_content", F.sha2(F.coalesce("html", F.lit("")), 256))
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["url", "_content"]).drop("_at", "_content")


def read_stream(captures: DataFrame, budget: int | None = None) -> DataFrame:
    """The batch results over a stream; row-local, so any output mode works."""
    return read_captures(captures, budget)


def latest_status(results: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each URL's newest status in each window of capture time."""
    timed = results.select("url", "status", F.to_timestamp("provenance.fetched_at").alias("at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "url").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def write_results(results: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append results to a folder, exactly once, until all that is there has been read."""
    return results.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
