"""Sources and sinks of captures: tables, HTML files, services' JSON, streams; results as JSON or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.outline import rendered_head

MOST_BYTES = 25 << 20
CAPTURE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fetched_at", T.StringType()),
    ]
)


def html_files(spark: SparkSession, path: str, base: str, most: int = MOST_BYTES) -> DataFrame:
    """(url, html, error) of HTML files below a folder; a file above ``most`` bytes is not read into a page but has an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    fits = F.col("length") <= most
    return files.select(
        F.concat(F.lit(base), name).alias("url"), F.when(fits, F.decode("content", "UTF-8")).alias("html"),
        F.when(~fits, F.struct(F.lit("retrieval").alias("kind"), F.lit("the body is too long").alias("message"))).alias("error")
    )


def capture_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table of captures with the columns of ``CAPTURE``; columns that are missing are null."""
    rows = spark.read.format(kind).load(path)
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CAPTURE))


def capture_stream(spark: SparkSession, path: str, kind: str = "json", per_trigger: int = 64) -> DataFrame:
    """Captures as they arrive in a folder."""
    return spark.readStream.format(kind).schema(CAPTURE).option("maxFilesPerTrigger", per_trigger).load(path)


def service_documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, service, document, error) of services' answers, one JSON text a line; a line that is not JSON keeps its text as an error."""
    rows = spark.read.text(path)
    v = F.try_parse_json("value")
    bad = v.isNull()
    return rows.select(
        F.try_variant_get(v, "$.key", "string").alias("key"), F.try_variant_get(v, "$.service", "string").alias("service"),
        F.to_json(F.try_variant_get(v, "$.document", "variant")).alias("document"), F.when(bad, F.col("value")).alias("error")
    )


def as_json(results: DataFrame) -> DataFrame:
    """Results as one JSON text each."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def as_text(outline: Column, content: Column, status: Column) -> Column:
    """A result for reading: its outline first."""
    total = F.aggregate(outline, F.lit(0).cast("bigint"), lambda a, s: a + s["token_count"])
    none = F.struct(F.lit(False).alias("has_tables"), content.contains("```").alias("has_code"), F.lit(False).alias("has_pagination"))
    return F.concat(rendered_head(outline, total, none), F.lit("\n\nCompleteness: "), status, F.lit("\n\n"), content)
