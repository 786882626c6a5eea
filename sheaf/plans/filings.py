"""Filings: a document against its folder's index and the items that its form must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import document_name, sibling
from sheaf.operators import manifests as M
from sheaf.operators import verdict as V
from sheaf.operators.dom import with_facts
from sheaf.plans.captures import as_results, data_of, provenance_of, shaped

#: Fixed value: the parts of inline tagged filings that readers don't see.
UNSEEN = r"(?is)<ix:(header|hidden)\b.*?</ix:\1>"


def declared_size(document: Column, name: Column) -> Column:
    """The bytes that an index declares for a document; null where it declares none."""
    items = F.try_variant_get(F.try_parse_json(document), "$.directory.item", "array<variant>")
    sizes = F.transform(
        F.filter(items, lambda i: F.try_variant_get(i, "$.name", "string") == name), lambda i: F.try_variant_get(i, "$.size", "string")
    )
    return F.get(F.filter(sizes, lambda s: s.rlike("^[0-9]{1,18}$")), 0).cast("long")


def filing_records(captures: DataFrame, indexes: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Captured filings in the columns of ``read_captures``.

    ``indexes``: (url, document), the JSON index of a filing's folder; without it, or where it names no size, the
    byte signal is open and no filing is complete. The join is by the index's URL, one row for each, and moves what
    was read of a page, never its markup. ``bytes``
    in ``captures`` is the length of the body as it was received; else that of ``html`` in UTF-8 counts.
    """
    have = set(captures.columns)
    rows = captures.withColumns({"final_url": F.col("final_url") if "final_url" in have else F.col("url"), "_raw": F.coalesce("html", F.lit(""))})
    rows = rows.withColumns(
        {
            "form": M.form_type(F.col("_raw")), "received": F.col("bytes").cast("long") if "bytes" in have else F.octet_length("_raw").cast("long"),
            "_index": sibling(F.col("final_url"), "index.json")
        }
    )
    rows = rows.withColumn("html", F.regexp_replace("_raw", UNSEEN, ""))
    rows = with_facts(rows, url="final_url", names=("markdown", "sections", "canonical", "error")).drop("html", "_raw")
    if indexes is None:
        rows = rows.withColumn("_document", F.lit(None).cast("string"))
    else:
        rows = rows.join(indexes.groupBy(F.col("url").alias("_index")).agg(F.min("document").alias("_document")), "_index", "left")
    rows = rows.withColumn("declared", declared_size(F.col("_document"), document_name(F.col("final_url"))))
    wanted, found = M.expected_items(F.col("form")), M.filing_items(F.col("facts.markdown"))
    rows = rows.withColumns({"missing": M.missing_items(wanted, found), "shown": F.col("facts.markdown"), "sections": F.col("facts.sections")})
    signals = V.evidence(filing_byte_manifest=F.col("declared") == F.col("received"), statutory_item_manifest=F.size("missing") == 0)
    rows, shape = shaped(rows.withColumn("signals", signals), budget)
    status = V.strict_status(F.col("signals"))
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("Items of the form were not found: "), F.array_join("missing", ", ")))
        .when(status == "incomplete", "The body is not as long as its index declares")
        .when(status == "complete", "The index's size and the form's items agree")
        .otherwise("The index or the form is not known, so the filing can't be judged")
    )
    return as_results(
        rows,
        captures,
        **shape,
        status=status,
        reason=reason,
        evidence=F.col("signals"),
        provenance=provenance_of(have, F.lit(0), F.col("facts.canonical")),
        structured_data=data_of(F.struct("form", F.col("received").alias("downloaded_bytes"), F.col("declared").alias("manifest_bytes"), "missing")),
        failure=F.when(status != "complete", "verification"),
        error=F.when(F.col("facts.error").isNotNull(), F.struct(F.lit("extraction").alias("kind"), F.col("facts.error").alias("message"))),
    )
