"""The public functions: read captures, extract HTML, read sections, read more."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.recipes import Registry
from sheaf.plans.captures import as_results, handle, read_captures, read_section
from sheaf.plans.ladder import read_ladder
from sheaf.plans.routed import read_routed
from sheaf.plans.scholarly import read_works

__all__ = ["AnalysisException", "extract_files", "extract_html", "read", "read_more", "read_tiers", "read_works", "sections_of", "snapshots"]


def read(captures: DataFrame, budget: int | None = None, registry: Registry | None = None) -> DataFrame:
    """One result for each capture (url, html, and status, final URL and time where known), with the recipe that its URL takes."""
    return read_routed(captures, budget, registry)


def read_tiers(captures: DataFrame, budget: int | None = None, required: Column | None = None) -> DataFrame:
    """One result for each URL from its captures by tier, of the one that counts."""
    return read_ladder(captures, budget, required=required)


def _supplied(results: DataFrame) -> DataFrame:
    """Results of HTML that was given: no tier and status, and evidence that nothing was fetched."""
    supplied = F.struct(F.lit("supplied_html").alias("name"), F.lit(None).cast("boolean").alias("passed"))
    return results.withColumns(
        {
            "evidence": F.array_append("evidence", supplied),
            "provenance": F.col("provenance").withField("tier", F.lit(None).cast("int")).withField("http_status", F.lit(None).cast("int"))
        }
    )


def extract_html(spark: SparkSession, html: str, url: str, budget: int | None = None) -> DataFrame:
    """The result of one HTML text that was supplied: without tier and status, and with evidence that nothing was fetched."""
    if not isinstance(html, str):
        raise TypeError("HTML must be a text")
    rows = spark.createDataFrame([(url, html)], "url string, html string").withColumn("handle", handle(F.col("url"), F.col("html")))
    return _supplied(read_captures(rows, budget))


def extract_files(files: DataFrame, budget: int | None = None) -> DataFrame:
    """Results of (url, html, error) as ``sources.captures.html_files`` gives them; a file that was not read is a result with its error."""
    lost = files.where("error is not null")
    plain = files.drop("error")
    read_ones = _supplied(read_captures(files.where("error is null").drop("error"), budget))
    return read_ones.unionByName(as_results(lost, plain, reason=F.col("error.message"), failure=F.col("error.kind"), error=F.col("error")))


def snapshots(captures: DataFrame) -> DataFrame:
    """Captures with a stable handle each: the table that sections are read from later."""
    return captures.withColumn("handle", handle(F.col("url"), F.col("html")))


def sections_of(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(handle, anchor, markdown, token_count, error) of the wanted (handle, anchor): an unknown handle or anchor is an error of its row."""
    found = read_section(stored, wanted.select("handle", "anchor").distinct(), "handle")
    known = stored.select("handle").distinct().withColumn("_known", F.lit(True))
    wrong = F.when(F.col("_known").isNull(), "the handle is not known").when(F.col("markdown").isNull(), "the page has no such section")
    return found.join(known, "handle", "left").withColumn("error", wrong).drop("_known")


def read_more(stored: DataFrame, handles: DataFrame, budget: int | None = None) -> DataFrame:
    """Stored snapshots read again with another budget, whole by default; their time of capture stays."""
    once = stored.join(handles.select("handle").distinct(), "handle", "left_semi").dropDuplicates(["handle"])
    return read_captures(once, budget)
