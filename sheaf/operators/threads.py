"""Discussion threads: ranking comments, fitting them to a budget, rendering, and the capture verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE_LIMIT = 200


def ranked(comments: DataFrame, thread: str = "thread", score: str = "score", pos: str = "pos") -> DataFrame:
    """Add ``rank``: scored comments first, greater scores first, ties and the rest in their order."""
    order = Window.partitionBy(thread).orderBy(F.col(score).desc_nulls_last(), F.col(pos))
    return comments.withColumn("rank", F.row_number().over(order))


def core(rows: DataFrame, budget: int, limit: int = CORE_LIMIT, head: int = 0, thread: str = "thread") -> DataFrame:
    """Add ``kept`` to ranked comments with ``token_count``: the longest prefix by rank within the limit and the budget."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    spent = F.sum("token_count").over(Window.partitionBy(thread).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("kept", (F.col("rank") <= limit) & (F.lit(head) + spent <= budget))


def completion_cost(rows: DataFrame, thread: str = "thread") -> DataFrame:
    """Each thread's comments that were not kept, and their tokens."""
    gone = ~F.col("kept")
    return rows.groupBy(thread).agg(
        F.count_if(gone).alias("remaining_items"), F.coalesce(F.sum(F.when(gone, F.col("token_count"))), F.lit(0)).alias("estimated_extra_tokens")
    )


def capture_status(captured: Column, reported: Column, deeper: Column) -> Column:
    """unknown without comments; incomplete with unloaded replies or fewer than were reported; else complete."""
    return F.when(captured == 0, "unknown").when(deeper > 0, "incomplete").when(
        F.coalesce(captured < reported, F.lit(False)), "incomplete"
    ).otherwise("complete")


def best_candidate(attempts: DataFrame, key: str, value: Column) -> DataFrame:
    """Of each key's attempts the one of best status, fewest unloaded replies and most comments; the first wins ties.

    Needs status, deeper, captured, attempt. One aggregation with map-side combining; no sort.
    """
    rank = F.when(F.col("status") == "complete", 2).when(F.col("status") == "incomplete", 1).otherwise(0)
    return attempts.groupBy(key).agg(F.max_by(value, F.struct(rank, -F.col("deeper"), F.col("captured"), -F.col("attempt"))).alias("best"))


def quoted(body: Column) -> Column:
    """A comment's body as a Markdown quotation."""
    return F.array_join(F.transform(F.split(body, "\r?\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def thread_markdown(threads: DataFrame, comments: DataFrame, thread: str = "thread") -> DataFrame:
    """(thread, markdown): title, then each ranked comment under a heading with its author and score."""
    heading = F.concat(
        F.lit("## "), F.coalesce("author", F.lit("unknown")), F.coalesce(F.concat(F.lit(" ("), F.col("score").cast("string"), F.lit(")")), F.lit(""))
    )
    blocks = comments.groupBy(thread).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.concat(heading, F.lit("\n\n"), quoted(F.col("body"))).alias("block")))).alias("blocks")
    )
    body = F.transform(F.coalesce("blocks", F.array().cast("array<struct<rank:int,block:string>>")), lambda b: b["block"])
    return threads.join(blocks, thread, "left").select(
        thread, F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), body), "\n\n").alias("markdown")
    )
