"""A corpus pipeline of five stages, each a table written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import exact_dedup, mixing, packing, simhash, toxicity
from sheaf.llm.rows import small, without
from sheaf.llm.store import remove, workspace, written
from sheaf.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the chain is fitted on the labelled documents, and those it rejects go.

    Each row is judged by its own text: null and empty texts are not rejected, repeated rows are judged alike,
    ids may be null or repeated, an empty table stays empty, and columns of other names are dropped.
    """
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one row of each group of equal texts stays.

    Null, empty and blank texts are equal. Of rows that repeat an id each is judged by its own text, rows without
    an id count as others but come last, and full repeats stay once. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs).select(*COLUMNS)


def keyed(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` written with a key for each row, ``row``: ids may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), f"{workspace(spark, name)}/rows")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies the document of the smallest id stays. Rows of null ids stay.

    Texts without words are alike. Rows are told apart by a key of their own, so a row that shares its id with a
    near copy stays. An empty table stays empty.
    """
    rows = keyed(spark, docs, "near")
    found = simhash.near_rows(rows, "row")
    lost = written(found.where("id is not null and row <> kept_row").select("row"), f"{workspace(spark, 'near')}/lost")
    return without(rows, lost, "row").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix reads it, twice at most, range-sorted along the curriculum.

    A reading that the mix cuts short is a whole row here: one at most of each source. Rows without words, null
    texts among them, which the mix reads never, go, and so do those beyond their source's target. Ids may be null
    or repeated, null sources are one source, the last, and an empty table stays empty.
    """
    rows = keyed(spark, docs, "mix")
    times = mixing.mixed(rows, row_col="row").select("row", F.explode(F.array_compact(F.array("position", "again_at"))).alias("position"))
    times = small(written(times, f"{workspace(spark, 'mix')}/times"))
    return rows.join(times, "row").repartitionByRange("position", "doc_id", "row").sortWithinPartitions("position", "doc_id", "row").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all readings and their places in sequences. Null and empty texts have their end id; rows of null or repeated ids are packed each by itself."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL has no classifier, tokenizer or bin packing; ``tests/llm/test_pipeline.py`` holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written and reread, so a failure repeats one stage at most.

    A stage's table goes once the next one is written. So do its shuffle files, which Spark frees when the driver
    collects garbage: that is asked for after each stage, as a long run may else keep those of all.
    """
    docs, at = table(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{at}/stage{k}")
        remove(spark, f"{at}/stage{k - 1}")
        spark._jvm.System.gc()
    return STAGES[-1][1](spark, docs, sf_dir)
