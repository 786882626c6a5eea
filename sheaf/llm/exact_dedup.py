"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.rows import matched, small, unused, without
from sheaf.llm.store import remove, workspace, written
from sheaf.sources.tables import table

WHITE = r"[\x20\x09-\x0D]"


def normal(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digest128(text: Column) -> Column:
    """MD5 as 16 bytes. Bytes are compared afterwards, so a made collision can't merge two texts."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """One row for each row of ``docs``: id, chars, sha256 (binary), keep_id, group_size, kept, row_key.

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with the most
    code points in its original text stays, then the smallest id; a null id comes last. Null texts are empty,
    and empties form one group. Of rows repeated in full exactly one is kept. An empty table gives no rows.
    Other columns of ``docs`` are ignored, whatever their names.

    Groups are counted with map-side aggregation, so a group of any size is one row for each task. Bytes are
    compared the same way: in groups of two rows or more, the least and greatest text must be the same. Only
    hashes where they differ are grouped again by their full text. Rows of a large group never meet in one task:
    groups are broadcast where they are few, and else the large ones are, of which there are few.
    """
    spark = docs.sparkSession
    at = workspace(spark, "exact")
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).withColumn("norm", normal(F.col("raw")))
    facts = written(
        text.select(
            "id", F.length("raw").alias("chars"), digest(F.col("norm")).alias("hash"),
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256"), F.monotonically_increasing_id().alias("row_key")
        ),
        f"{at}/facts",
    )
    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), "id", "row_key")).alias("best")
    groups = written(facts.groupBy("hash").agg(F.count("*").alias("group_size"), best).where("group_size > 1"), f"{at}/groups")
    hashed = text.select("norm", digest(F.col("norm")).alias("hash"))
    several = matched(hashed, groups.select("hash", "group_size"), ["hash"], "group_size", "left_semi")
    clashes = written(
        several.groupBy("hash").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("hash"), f"{at}/clashes"
    )
    if clashes.isEmpty():
        remove(spark, f"{at}/clashes")
        judged = matched(facts, groups, ["hash"], "group_size", "left")
    else:  # two texts share a hash: the SHA-256 tells them apart there, after the bytes have shown which hashes need it
        shared = facts.join(clashes, "hash", "left_semi")
        plain = facts.join(clashes, "hash", "left_anti").join(groups, "hash", "left")
        texts = text.select(
            "norm", digest(F.col("norm")).alias("hash"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256")
        ).join(clashes, "hash", "left_semi")
        unlike = texts.groupBy("hash", "sha256").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high")
        if not unlike.isEmpty():
            raise ValueError("two different texts have the same SHA-256")
        parted = shared.groupBy("hash", "sha256").agg(F.count("*").alias("group_size"), best)
        judged = plain.unionByName(shared.join(parted, ["hash", "sha256"]).select(*plain.columns))
    alone = F.col("group_size").isNull()
    return judged.select(
        "id",
        "chars",
        "sha256",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_key") == F.col("best.row_key"))).alias("kept"),
        "row_key",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, whatever their names. Ids tell rows apart; rows that repeat an id or have none are told apart by content,
and full repeats stay once."""
    at = workspace(docs.sparkSession, "exact-kept")
    found = written(exact_groups(docs, id_col, text_col), f"{at}/groups")
    repeats = written(found.groupBy("id").agg(F.count("*").alias("n"), F.max("kept").alias("any")).where("n > 1 or id is null"), f"{at}/repeats")
    lost = written(found.where("not kept").join(repeats, "id", "left_anti").select(F.col("id").alias(id_col)), f"{at}/lost")
    if repeats.isEmpty():
        return without(docs, lost, id_col)
    # rows of such ids are told apart by content, and full repeats fall together
    own, sha, chars, own_sha, own_chars = unused(docs, "own_id", "sha", "chars", "own_sha", "own_chars")
    same = F.col(id_col).eqNullSafe(F.col(own))
    repeated = small(repeats).select(F.col("id").alias(own))
    once = docs.join(repeated, same, "left_anti")
    again = docs.join(repeated, same, "left_semi").withColumns(
        {sha: F.unhex(F.sha2(normal(F.col(text_col)).cast("binary"), 256)), chars: F.length(F.coalesce(F.col(text_col), F.lit("")))}
    )
    kept = found.where("kept").join(repeated, F.col("id").eqNullSafe(F.col(own)), "left_semi").select(
        F.col("id").alias(own), F.col("sha256").alias(own_sha), F.col("chars").alias(own_chars)
    )
    chosen = again.join(
        kept, same & (F.col(sha) == F.col(own_sha)) & (F.col(chars) == F.col(own_chars)), "left_semi"
    ).dropDuplicates([id_col, sha, chars])
    return without(once, lost, id_col).unionByName(chosen.select(*docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that its group of equal texts keeps."""
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
