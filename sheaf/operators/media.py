"""Listings and videos from their captures."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import listing_id
from sheaf.operators.dom import Tree, walk_json
from sheaf.operators.manifests import listing
from sheaf.operators.verdict import listing_status

#: A listing's fields, and the words by which its scripts are known.
FIELDS = (
    "marketplace_listing_title", "base_marketplace_listing_title", "custom_title", "listing_price", "formatted_price", "condition",
    "redacted_description", "location_text", "location", "creation_time", "is_live", "is_sold", "is_pending"
)
MARK = "marketplace_listing_title"


def listing_fields(html: str | None, item: str | None) -> str:
    """JSON of a listing's fields: of all objects with its id, in order, the first value of each field that is not empty."""
    found: dict[str, Any] = {}
    for node in Tree(html or "").root.all("script"):
        text = "".join(node.texts())
        if node.get("type") == "application/json" and MARK in text:
            try:
                block = json.loads(text)
            except (ValueError, RecursionError):
                continue
            for part in walk_json(block):
                if isinstance(part, dict) and item and str(part.get("id", "")) == item:
                    found = {f: part[f] for f in FIELDS if part.get(f) not in (None, "", {}, [])} | found
    return json.dumps(found)


def _fields(html: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([listing_fields(h, i) for h, i in zip(html, item, strict=True)])


def listing_results(captures: DataFrame) -> DataFrame:
    """Each captured listing's item, fields, status and Markdown. Row-local; a page without the item's objects is unknown."""
    rows = captures.withColumn("item", listing_id(F.col("url"))).withColumn(
        "_json", F.pandas_udf(_fields, "string")(F.col("html"), F.col("item"))
    ).withColumn("fields", listing(F.col("_json")))
    fact = lambda name, value: F.concat(F.lit(f"- **{name}:** "), value)
    flag = lambda name: F.coalesce(F.get_json_object("_json", f"$.{name}") == "true", F.lit(False))
    facts = F.array_compact(
        F.array(
            fact("Price", F.col("fields.price")), fact("Condition", F.nullif(F.trim("fields.condition"), F.lit(""))),
            fact("Location", F.col("fields.location")),
            F.when(flag("is_sold"), "- **Status:** Sold").when(flag("is_pending"), "- **Status:** Sale pending")
        )
    )
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("# "), F.coalesce("fields.title", F.lit("Facebook Marketplace listing"))), F.nullif(F.array_join(facts, "\n"), F.lit("")),
            F.concat(F.lit("## Description\n\n"), F.col("fields.description"))
        )
    )
    status = listing_status(
        F.col("fields.title"), F.col("fields.price"), F.col("fields.description"), F.nullif(F.trim("fields.condition"), F.lit(""))
    )
    return rows.select(
        *(c for c in captures.columns if c != "html"), "item", "fields", status.alias("status"), F.array_join(parts, "\n\n").alias("content")
    )


def chosen_track(tracks: Column) -> Column:
    """Of array<struct<..., is_generated>> the first track that a person wrote, else the first."""
    return F.coalesce(F.get(F.filter(tracks, lambda t: ~F.coalesce(t["is_generated"], F.lit(False))), 0), F.get(tracks, 0))


def video_markdown(title: Column, video: Column, description: Column, chapters: Column, transcript: Column) -> Column:
    """Title, description, chapters (array<struct<start_time, title>>) and transcript; parts that are not there are left out."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    lines = F.transform(
        chapters,
        lambda c: F.concat(
            F.lit("- "), F.bround(F.coalesce(c["start_time"], F.lit(0)).cast("double")).cast("long").cast("string"), F.lit("s: "),
            F.coalesce(c["title"], F.lit("Untitled"))
        )
    )
    parts = F.array(
        F.concat(F.lit("# "), F.coalesce(given(title), video)), F.concat(F.lit("## Description\n\n"), given(description)),
        F.concat(F.lit("## Chapters\n\n"), F.nullif(F.array_join(lines, "\n"), F.lit(""))), F.concat(F.lit("## Transcript\n\n"), given(transcript))
    )
    return F.array_join(F.array_compact(parts), "\n\n")
