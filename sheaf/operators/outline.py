"""Section outlines and token budgets.

``sections``: one row for each section of a document, with doc, pos, heading, level, anchor, token_count,
char_count, markdown. Everything works within a document, so one shuffle by document serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import count_tokens, cut_at_headings, heading_of, slugify

#: The rule below a table's head, and the words of pages.
TABLE_RULE = r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
PAGED = r"(?im)(?:\bpage\s+\d+\s+of\s+\d+\b|^\s*\[(?:next|older|more)\]\([^\n]+\)\s*$)"


def with_anchors(rows: DataFrame, doc: str = "doc", pos: str = "pos", heading: str = "heading") -> DataFrame:
    """Add ``anchor``: the heading's slug, numbered from the second time that a document uses it."""
    n = F.row_number().over(Window.partitionBy(doc, "_slug").orderBy(pos))
    numbered = rows.withColumn("_slug", slugify(F.col(heading))).withColumn("_n", n)
    return numbered.withColumn("anchor", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", "_n"))).drop("_slug", "_n")


def sections(docs: DataFrame, doc: str = "doc", markdown: str = "markdown") -> DataFrame:
    """Cut each Markdown document at its headings outside fences.

    Text before the first heading is a section named Document of level 0 unless it is blank; a text without
    headings is one such section, an empty or null one none. ``pos`` numbers a document's cuts from 0, the text before
    the first heading, and may leave it out. Row-local up to the anchors' window.
    """
    parts = docs.where(F.length(markdown) > 0).select(
        F.col(doc).alias("doc"), F.posexplode(cut_at_headings(F.col(markdown))).alias("pos", "markdown"),
        F.size(cut_at_headings(F.col(markdown))).alias("n")
    )
    kept = parts.where((F.col("pos") > 0) | (F.col("n") == 1) | F.col("markdown").rlike(r"(?U)\S"))
    head = heading_of(F.col("markdown"))
    rows = kept.select(
        "doc", "pos", F.when(F.col("pos") > 0, head["heading"]).otherwise("Document").alias("heading"),
        F.when(F.col("pos") > 0, head["level"]).otherwise(0).alias("level"), "markdown"
    )
    return with_anchors(rows.withColumns({"token_count": count_tokens(F.col("markdown")), "char_count": F.length("markdown")}))


def flags(markdown: Column, paginated: Column | None = None) -> Column:
    """struct(has_tables, has_code, has_pagination) of a whole document."""
    paged = markdown.rlike(PAGED)
    return F.struct(
        markdown.rlike(TABLE_RULE).alias("has_tables"), markdown.rlike(r"(?m)^\s*(`{3,}|~{3,})").alias("has_code"),
        (paged if paginated is None else paginated | paged).alias("has_pagination")
    )


def outline(rows: DataFrame) -> DataFrame:
    """One row for each document: its sections in order, and their tokens."""
    own = F.sort_array(F.collect_list(F.struct("pos", "heading", "level", "anchor", "token_count", "char_count")))
    return rows.groupBy("doc").agg(own.alias("sections"), F.sum("token_count").alias("section_tokens"))


def fitted(rows: DataFrame, budget: int, whole: Column | None = None, head: int = 0) -> DataFrame:
    """Add ``kept``: whether a section belongs to the longest prefix of whole sections within ``budget`` tokens.

    ``whole`` is the token count of the whole document: where that fits, all is kept, although the sections'
    rounded counts may add up to more. ``head`` tokens are spent before the first section.
    """
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
        raise ValueError("the budget must be a non-negative integer")
    spent = F.sum("token_count").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.lit(head) + spent <= budget
    return rows.withColumn("kept", fits if whole is None else (whole <= budget) | fits)


def prefix(rows: DataFrame) -> DataFrame:
    """One row for each document of ``fitted`` sections: content, truncated, omitted anchors, and the cost of the rest."""
    kept, gone = F.col("kept"), ~F.col("kept")
    part = F.sort_array(F.collect_list(F.when(kept, F.struct("pos", "markdown"))))
    out = F.sort_array(F.collect_list(F.when(gone, F.struct("pos", "anchor"))))
    return rows.groupBy("doc").agg(
        F.regexp_replace(F.array_join(F.transform(part, lambda x: x["markdown"]), ""), r"\s+$", "").alias("content"),
        F.coalesce(F.bool_or(gone), F.lit(False)).alias("truncated"),
        F.transform(out, lambda x: x["anchor"]).alias("omitted"),
        F.count_if(gone).alias("remaining_items"),
        F.coalesce(F.sum(F.when(gone, F.col("token_count"))), F.lit(0)).alias("estimated_extra_tokens"),
    )


def cost_of(omitted: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, remaining_items, estimated_extra_tokens, unknown) for listed anchors (doc, anchor).

    Of sections that share an anchor the last one's tokens count; ``unknown`` lists anchors that the outline lacks.
    """
    last = rows.groupBy("doc", "anchor").agg(F.max_by("token_count", "pos").alias("tokens"))
    found = omitted.join(last, ["doc", "anchor"], "left")
    return found.groupBy("doc").agg(
        F.count("*").alias("remaining_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("estimated_extra_tokens"),
        F.sort_array(F.collect_list(F.when(F.col("tokens").isNull(), F.col("anchor")))).alias("unknown")
    )


def section_by_anchor(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first section of each wanted (doc, anchor); a null markdown tells that there is none."""
    first = rows.groupBy("doc", "anchor").agg(F.min_by("markdown", "pos").alias("markdown"))
    return wanted.join(first, ["doc", "anchor"], "left").withColumn("markdown", F.regexp_replace("markdown", r"\s+$", ""))


def rendered_head(sections_column: Column, total: Column, flag: Column) -> Column:
    """The outline as text: tokens, flags, and an indented line for each section."""
    names = F.array_compact(F.array(*(F.when(flag[f"has_{n}"], F.lit(n)) for n in ("tables", "code", "pagination"))))
    shown = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("none")
    line = lambda s: F.concat(
        F.repeat(F.lit("  "), F.greatest(s["level"] - 1, F.lit(0))), F.lit("- "), s["heading"], F.lit(" [#"), s["anchor"], F.lit("] ("),
        s["token_count"].cast("string"), F.lit(" approx. tokens, "), s["char_count"].cast("string"), F.lit(" chars)")
    )
    body = F.when(F.size(sections_column) == 0, F.array(F.lit("(No sections extracted)"))).otherwise(F.transform(sections_column, line))
    head = F.array(
        F.lit("# Outline"), F.lit(""), F.concat(F.lit("Approximate tokens: "), total.cast("string")), F.concat(F.lit("Content flags: "), shown),
        F.lit("")
    )
    return F.array_join(F.concat(head, body), "\n")
