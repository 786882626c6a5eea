"""Captures read by the recipes that their URLs take: threads, listings, pages that need permission, and all others."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import linkedin_class, registrable_domain
from sheaf.operators.discussions import thread_results
from sheaf.operators.dom import BLOCK_FACTS, block_signal, with_facts
from sheaf.operators.media import listing_results
from sheaf.operators.recipes import Recipe, Registry
from sheaf.operators.verdict import evidence
from sheaf.plans.captures import ERROR, EVIDENCE, OUTLINE, as_results, check_budget, data_of, error, provenance_of, read_captures, sections_column, shaped
from sheaf.plans.filings import filing_records
from sheaf.plans.videos import video_records
from sheaf.sources.workspace import has_workspace, workspace, written


def thread_records(captures: DataFrame, budget: int | None = None) -> DataFrame:
    """Threads in the columns of ``read_captures``, one result for each capture."""
    return _thread_results(thread_results(captures, budget), captures)


def _thread_results(found: DataFrame, captures: DataFrame, passed_over: Column | None = None) -> DataFrame:
    """``passed_over``: the evidence of rows without a thread; without it such rows are errors."""
    bad, deeper = F.col("structured_data").isNull(), F.col("structured_data.deeper_reply_count")
    status = F.coalesce("status", F.lit("unknown"))
    passed = F.when(status == "complete", True).when(status == "incomplete", False)
    name = F.when((status == "incomplete") & (deeper == 0), "redlib_comment_count").otherwise("redlib_deeper_replies")
    none = {"content": F.lit(""), "outline": F.array().cast(OUTLINE), "coverage": F.lit("full"), "truncated": F.lit(False)}
    none |= {"omitted": F.array().cast("array<string>"), "reason": F.lit("No front end gave a thread that can be judged")}
    over = F.array().cast(EVIDENCE) if passed_over is None else passed_over.cast(EVIDENCE)
    return as_results(
        found,
        captures,
        **{c: F.coalesce(c, value) for c, value in none.items()},
        status=status,
        evidence=F.when(bad, over).otherwise(F.array(F.struct(name.alias("name"), passed.alias("passed")))),
        provenance=provenance_of(set(captures.columns), F.lit(2) if passed_over is None else F.when(~bad, 2), F.col("url")),
        structured_data=data_of(F.col("structured_data")),
        cost_to_complete=F.when(
            F.col("cost_to_complete").isNotNull(), F.struct("cost_to_complete.remaining_items", "cost_to_complete.estimated_extra_tokens")
        ),
        failure=F.when(status != "complete", "verification"),
        error=F.lit(None).cast(ERROR) if passed_over is not None else F.when(bad, error("policy", F.col("reason"))),
    )


def best_threads(captures: DataFrame, budget: int | None = None, order: str = "instance") -> DataFrame:
    """One result for each thread's ``url`` from its captures at several front ends, which ``order`` numbers.

    A capture that failed, is a block page, has no successful status, can't be parsed or shows no comment is
    passed over and leaves its evidence. Of the rest the first complete one counts, else the best by status,
    unloaded replies and comments. Without any the result is unknown, with the evidence of all. One aggregation
    by URL, combining in the map tasks; budgets cut before, row by row.
    """
    have = set(captures.columns)
    rows = with_facts(captures, names=BLOCK_FACTS).withColumn(
        "_blocked",
        block_signal(
            F.col("html"), F.col("facts"), F.col("http_status") if "http_status" in have else F.lit(None).cast("int"),
            F.col("final_url") if "final_url" in have else F.col("url")
        )["detected"]
    )
    lost = F.col("error").isNotNull() if "error" in have else F.lit(False)
    code = F.col("http_status") if "http_status" in have else F.lit(200)
    gate = F.when(lost, "it could not be captured").when(F.col("_blocked"), "it shows a block page").when(
        ~F.coalesce(code, F.lit(200)).between(200, 299), "its status is no success"
    )
    plain = rows.withColumn("_gate", gate).drop("facts", "_blocked", "error")
    found = thread_results(plain, budget)
    captured, deeper = F.col("structured_data.captured_comment_count"), F.col("structured_data.deeper_reply_count")
    gate = F.coalesce("_gate", F.when(F.col("structured_data").isNull(), F.col("reason")), F.when(captured == 0, "it shows no comment"))
    full = F.col("status") == "complete"
    rank = F.when(full, 2).when(F.col("status") == "incomplete", 1).otherwise(0)
    best = F.struct(rank, F.when(full, 0).otherwise(-deeper), F.when(full, 0).otherwise(captured), -F.col(order))
    kept = [c for c in found.columns if c not in ("url", "_gate", order)]
    passed_over = F.concat_ws(" ", F.lit("front end"), F.concat(F.col(order).cast("string"), F.lit(":")), gate)
    merged = found.groupBy("url").agg(
        F.max_by(F.struct(*kept), F.when(gate.isNull(), best)).alias("best"),
        F.sort_array(F.collect_list(F.when(gate.isNotNull(), F.struct(F.col(order).alias("at"), passed_over.alias("name"))))).alias("over"),
    )
    over = F.transform("over", lambda x: F.struct(x["name"].alias("name"), F.lit(False).alias("passed")))
    shown = captures.select("url", *(c for c in kept if c in have))
    return _thread_results(merged.select("url", "best.*", over.alias("over")), shown, F.col("over"))


def listing_records(captures: DataFrame, budget: int | None = None) -> DataFrame:
    """Listings in the columns of ``read_captures``."""
    found = listing_results(captures).withColumnRenamed("content", "shown")
    rows, shape = shaped(found.withColumn("sections", sections_column(F.col("shown"))), budget)
    fields = ("title", "price", "description", "condition")
    signals = F.array(
        *(F.struct(F.lit(f"listing_{f}").alias("name"), F.coalesce(F.trim(f"fields.{f}") != "", F.lit(False)).alias("passed")) for f in fields)
    )
    reason = F.when(
        F.col("status") == "complete", "Title, price, description and condition were captured"
    ).when(F.col("status") == "incomplete", "A field of the listing is missing").otherwise("No object of this listing was captured")
    canonical = F.concat(F.lit("https://www.facebook.com/marketplace/item/"), F.col("item"))
    return as_results(
        rows, captures, **shape, status=F.col("status"), reason=reason, evidence=signals,
        provenance=provenance_of(set(captures.columns), F.lit(0), canonical), structured_data=data_of(F.struct("item", "fields"))
    )


def withheld_records(captures: DataFrame, reason: Column | str, signal: str = "persistent_profile") -> DataFrame:
    """Captures that are not read without permission: an unknown status, no content and no structured data."""
    return as_results(
        captures, captures, reason=F.lit(reason) if isinstance(reason, str) else reason, evidence=evidence(**{signal: F.lit(False)}),
        failure=F.lit("auth")
    )


def opt_in_records(captures: DataFrame, budget: int | None = None, opted_in: bool = False, profiles: Collection[str] = ()) -> DataFrame:
    """Pages of a site that is read only where its user opted in and has a sign-in stored; all others are withheld.

    ``profiles``: the domains with a stored sign-in. Profiles count only as captures of tier 4, if captures say
    their tier; the record says what kind of page it is.
    """
    kind = linkedin_class(F.col("url"))
    domain = registrable_domain(F.col("url"))
    known = domain.isin(*profiles) if profiles else F.lit(False)
    anonymous = (kind == "profile") & (F.coalesce(F.col("tier"), F.lit(1)) != 4) if "tier" in captures.columns else F.lit(False)
    allowed = F.lit(opted_in) & F.coalesce(known, F.lit(False)) & ~anonymous
    missing = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.lit(not opted_in), "its user opts in"),
                F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("a sign-in for "), domain, F.lit(" is stored"))),
                F.when(anonymous, "its capture is signed in")
            )
        ),
        " and "
    )
    closed = withheld_records(
        captures.where(~allowed), F.concat(F.lit("This page is a "), kind, F.lit(" and is read only when "), missing), "opt_in_policy"
    )
    return read_captures(captures.where(allowed), budget).unionByName(closed) if opted_in and profiles else closed


def built_in(
    budget: int | None = None, indexes: DataFrame | None = None, tracks: DataFrame | None = None, opted_in: bool = False,
    profiles: Collection[str] = ()
) -> Registry:
    """The registry whose threads, listings, filings, videos and pages behind sign-in have transforms of their own.

    ``indexes``, ``tracks``: see ``filing_records`` and ``video_records``. Works are read by
    ``plans.scholarly.read_works``, which needs services' answers and candidates beside the captures.
    """
    own = {
        "reddit": lambda rows: thread_records(rows, budget),
        "facebook_marketplace": lambda rows: listing_records(rows, budget),
        "linkedin": lambda rows: opt_in_records(rows, budget, opted_in, profiles),
        "sec_filings": lambda rows: filing_records(rows, indexes, budget),
        "youtube": lambda rows: video_records(rows, tracks, budget),
    }
    registry = Registry()
    return Registry(tuple(Recipe(r.name, r.priority, r.patterns, own.get(r.name), r.name == "linkedin") for r in registry.recipes))


def read_routed(captures: DataFrame, budget: int | None = None, registry: Registry | None = None) -> DataFrame:
    """One result for each capture by its recipe.

    Each recipe with a transform is a branch that reads its own captures only: they are written once, partitioned
    by ``recipe``, to the shared folder, so no branch reads the pages of another. Captures that have the column,
    as a table that is stored that way, are read as they are; so are all on a cluster without a shared folder.
    """
    check_budget(budget)
    own = registry or built_in(budget)
    if "recipe" not in captures.columns and has_workspace(captures.sparkSession):
        captures = written(own.routed(captures), f"{workspace(captures.sparkSession, 'routed')}/captures", "recipe")
    return own.applied(captures, lambda rows: read_captures(rows, budget))
