"""The end-to-end read of captured pages: facts, evidence, verdict, outline and budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import count_tokens
from sheaf.functions.urls import is_http_url, public_url
from sheaf.operators import verdict as V
from sheaf.operators.attempts import failure, redirect_chain
from sheaf.operators.dom import block_signal, sections_of, with_facts


#: Headers by which a browser tells how it captured a page.
TRUNCATED, POLICY, RENDER_MS = "x-capture-truncated", "x-capture-policy", "x-render-ms"
SECTIONS = "array<struct<heading:string,level:int,anchor:string,token_count:long,char_count:int,markdown:string>>"
OUTLINE = "array<struct<heading:string,level:int,anchor:string,token_count:long,char_count:int>>"
EVIDENCE = "array<struct<name:string,passed:boolean>>"
COST = "struct<remaining_items:int,estimated_extra_tokens:bigint>"
DATA = "struct<json_ld:array<string>,feeds:array<string>,oembed:array<string>>"
ERROR = "struct<kind:string,message:string>"


def header(have: set[str], name: str) -> Column:
    """A capture's header, whatever the case of its name; null where there is none."""
    if "headers" not in have:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name), 0)["value"]


def error(kind: str, message: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def verified(captures: DataFrame, covered: bool = False) -> DataFrame:
    """Add ``facts``, ``block``, ``evidence``, ``status``, ``reason``, ``failure`` and ``error`` to captures.

    Needs url and html; http_status, final_url and headers are used where they are there. A URL that is not
    absolute HTTP(S) gives an error and an unknown status, and so does a page that can't be parsed, never a
    failed job. A capture that its browser cut short is incomplete.
    """
    have = set(captures.columns)
    rows = captures.withColumns(
        {
            "http_status": F.col("http_status") if "http_status" in have else F.lit(None).cast("int"),
            "final_url": F.col("final_url") if "final_url" in have else F.col("url")
        }
    )
    rows = with_facts(rows, url="final_url")
    rows = rows.withColumns(
        {
            "block": block_signal(F.col("html"), F.col("facts"), F.col("http_status"), F.col("final_url")),
            "_cut": F.coalesce(header(have, TRUNCATED) == "true", F.lit(False))
        }
    )
    rows = rows.withColumns(
        {
            "_heading": V.heading_signal(F.size("facts.headings"), F.col("facts.represented")),
            "_coverage": V.coverage_signal(F.col("facts.words"), F.col("facts.output_words")),
            "_length": V.length_signal(F.col("facts.declared"), F.col("facts.output_words")),
            "_pagination": V.pagination_signal(F.col("facts.paginated"), F.lit(covered)),
        }
    )
    own = [F.col(c) for c in ("_heading", "_coverage", "_length")] + [F.col("block.detected"), F.col("_pagination")]
    signals = {
        "heading_presence": own[0], "dom_vs_output_coverage": own[1], "blockpage_check": ~own[3], "length_sanity": own[2],
        "pagination_coverage": own[4]
    }
    valid, unread, cut = is_http_url(F.col("url")), F.col("facts.error"), F.col("_cut") & ~F.col("block.detected")
    sound = valid & unread.isNull()
    evidence = V.evidence(**signals)
    rows = rows.withColumns(
        {
            "evidence": F.when(cut, F.concat(evidence, V.evidence(capture_truncation=F.lit(False)))).otherwise(evidence),
            "status": F.when(sound, V.truncated_capture(V.generic_status(*own), F.col("_cut"), own[3])).otherwise("unknown"),
        }
    )
    failed = F.array_join(F.transform(F.filter("evidence", lambda e: V.is_false(e["passed"])), lambda e: e["name"]), ", ")
    reason = (
        F.when(F.col("block.detected"), "A block page may have replaced the requested page")
        .when(cut, "The browser cut its capture short")
        .when(F.col("status") == "incomplete", F.concat(F.lit("Independent evidence shows a gap: "), failed))
        .when(F.col("status") == "complete", "Independent signals agree")
        .otherwise("There is too little independent evidence")
    )
    gap = failure(F.col("block.auth_required"), F.col("block.detected"), V.is_false(F.col("_pagination")), F.col("status"))
    wrong = F.when(~valid, error("policy", "only absolute HTTP(S) URLs are read")).when(unread.isNotNull(), error("extraction", unread))
    return rows.withColumns(
        {"reason": reason, "failure": F.when(sound, gap).when(valid, "extraction").otherwise(gap), "error": wrong.cast(ERROR)}
    ).drop("_heading", "_coverage", "_length", "_pagination", "_cut")


def read_captures(captures: DataFrame, budget: int | None = None, covered: bool = False) -> DataFrame:
    """One result for each capture: url, content, outline, status, reason, evidence, provenance, coverage, truncated, omitted, cost.

    The whole capture is judged before the budget cuts it, so a budget never changes a verdict. Content and
    structured data of authentication walls are withheld, and URLs are shown without user, query and fragment.
    The budget cut is row-local: each document's sections stay in one array, so nothing is shuffled.
    """
    check_budget(budget)
    return results_of(verified(captures, covered), captures, budget, F.lit(1))


def results_of(judged: DataFrame, captures: DataFrame, budget: int | None, tier: Column, latency: Column | None = None) -> DataFrame:
    """Verified captures as results. ``captures``: the table they come from, for its columns; ``latency``: what rendering took."""
    auth = F.col("block.auth_required")
    rows = judged.withColumns(
        {
            "shown": F.when(auth, "").otherwise(F.col("facts.markdown")),
            "sections": F.when(auth, F.slice("facts.sections", 1, 0)).otherwise(F.col("facts.sections"))
        }
    )
    rows, shape = shaped(rows, budget)
    provenance = provenance_of(set(captures.columns), tier, F.col("facts.canonical"))
    data = F.when(~auth, F.struct("facts.json_ld", "facts.feeds", "facts.oembed"))
    found = rows.select(
        *kept_columns(captures),
        public_url(F.col("url")).alias("url"),
        shape["content"],
        shape["outline"],
        "status",
        "reason",
        "evidence",
        provenance.alias("provenance"),
        data.alias("structured_data"),
        *(shape[c] for c in ("coverage", "truncated", "omitted", "cost_to_complete")),
        "failure",
        "error",
        *([] if latency is None else [tier.alias("_tier"), latency.alias("_latency")]),
    )
    if latency is None:
        return found
    known = F.col("cost_to_complete").isNotNull() & (F.col("_tier") >= 2)
    return found.withColumn(
        "completion", F.when(known, F.struct(F.col("_tier").alias("required_tier"), F.col("_latency").alias("estimated_latency_ms")))
    ).drop("_tier", "_latency")


def as_results(rows: DataFrame, captures: DataFrame, **given: Column) -> DataFrame:
    """Rows in the columns of ``read_captures``: those given, and for the others what a result without content has."""
    empty = lambda kind: F.lit(None).cast(kind)
    status = given.get("status", F.lit("unknown"))
    own = {
        "url": public_url(F.col("url")),
        "content": F.lit(""),
        "outline": F.array().cast(OUTLINE),
        "status": status,
        "reason": empty("string"),
        "evidence": F.array().cast(EVIDENCE),
        "provenance": provenance_of(set(captures.columns), empty("int"), F.col("url")),
        "structured_data": empty(DATA),
        "coverage": F.lit("full"),
        "truncated": F.lit(False),
        "omitted": F.array().cast("array<string>"),
        "cost_to_complete": empty(COST),
        "failure": F.when(status != "complete", "verification"),
        "error": empty(ERROR),
    } | given
    return rows.select(*kept_columns(captures), *(c.alias(k) for k, c in own.items()))


def data_of(record: Column) -> Column:
    """A recipe's record as the structured data of a result: one JSON text."""
    none = F.array().cast("array<string>")
    return F.when(record.isNotNull(), F.struct(F.array(F.to_json(record)).alias("json_ld"), none.alias("feeds"), none.alias("oembed")))


def sections_column(markdown: Column) -> Column:
    """The sections of rendered Markdown, as those of a page."""

    @F.pandas_udf(SECTIONS)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([sections_of(t or "") for t in texts])

    return cut(markdown)


def check_budget(budget: int | None) -> None:
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int) or budget < 0):
        raise ValueError("the budget must be a non-negative integer")


def kept_columns(captures: DataFrame) -> list[str]:
    """The columns of captures that results keep as they are."""
    return [c for c in captures.columns if c not in ("html", "url", "http_status", "final_url", "fetched_at")]


def provenance_of(have: set[str], tier: Column, canonical: Column) -> Column:
    """Where a result comes from. URLs are shown without user, query and fragment; ``have``: the captures' columns."""
    given = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    final = F.coalesce(given("final_url", "string"), F.col("url")) if "final_url" not in have else F.col("final_url")
    status = given("http_status", "int")
    return F.struct(
        tier.alias("tier"), F.lit("capture").alias("engine"), public_url(canonical).alias("canonical_url"),
        given("fetched_at", "string").alias("fetched_at"), F.when(status.between(100, 599), status).alias("http_status"),
        public_url(final).alias("final_url"), F.array_distinct(F.array(public_url(F.col("url")), public_url(final))).alias("source_urls")
    )


def shaped(rows: DataFrame, budget: int | None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with ``shown`` and its ``sections`` cut to a budget, and the columns that say how: whole sections only, in one row's arrays."""
    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("kept"))

    def fit(s: Column, section: Column) -> Column:
        used = s["used"] + section["token_count"]
        return F.struct(used.alias("used"), F.when(used <= F.lit(budget), s["kept"] + 1).otherwise(s["kept"]).alias("kept"))

    whole = count_tokens(F.col("shown"))
    rows = rows.withColumn(
        "kept",
        F.size("sections") if budget is None else F.when(whole <= budget, F.size("sections")).otherwise(
            F.aggregate("sections", none, fit, lambda s: s["kept"])
        )
    )
    left = F.filter("sections", lambda s, i: i >= F.col("kept"))
    content = F.regexp_replace(
        F.array_join(F.transform(F.slice("sections", 1, F.greatest("kept", F.lit(0))), lambda s: s["markdown"]), ""), r"\s+$", ""
    )
    cost = F.when(
        F.size(left) > 0,
        F.struct(
            F.size(left).alias("remaining_items"),
            F.aggregate(left, F.lit(0).cast("bigint"), lambda a, s: a + s["token_count"]).alias("estimated_extra_tokens")
        )
    )
    outline = F.transform(
        "sections",
        lambda s: F.struct(
            s["heading"].alias("heading"), s["level"].alias("level"), s["anchor"].alias("anchor"), s["token_count"].alias("token_count"),
            s["char_count"].alias("char_count")
        )
    )
    found = {
        "content": F.when(F.col("kept") == F.size("sections"), F.col("shown")).otherwise(content),
        "outline": outline,
        "coverage": F.when(F.size(left) > 0, "core").otherwise("full"),
        "truncated": F.size(left) > 0,
        "omitted": F.transform(left, lambda s: s["anchor"]),
        "cost_to_complete": cost,
    }
    return rows, {k: v.alias(k) for k, v in found.items()}


def read_section(captures: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, anchor, markdown, token_count) for wanted (key, anchor) of stored captures; a null markdown is an unknown handle or anchor."""
    rows = with_facts(captures, names=("sections",)).select(
        key, F.posexplode("facts.sections").alias("pos", "s")
    ).select(key, "pos", "s.anchor", "s.markdown", "s.token_count")
    first = rows.groupBy(key, "anchor").agg(F.min_by("markdown", "pos").alias("markdown"), F.min_by("token_count", "pos").alias("token_count"))
    return wanted.join(first, [key, "anchor"], "left")


def followed(captures: DataFrame, most: int = 2) -> DataFrame:
    """Captures with ``landed``, the URL of the capture that a thin page's own redirect leads to, at most ``most`` times; itself where none does."""
    hops = with_facts(captures, names=("redirect",)).select(
        F.col("url").alias("from_url"), F.col("facts.redirect").alias("to_url")
    ).where("to_url is not null")
    ends = redirect_chain(captures.select("url").distinct(), hops, most).select("url", F.col("final").alias("landed"))
    return captures.join(ends, "url", "left")


def handle(url: Column, html: Column) -> Column:
    """A capture's stable handle."""
    return F.sha2(F.concat_ws("\n", url, html), 256)


def violations(results: DataFrame) -> DataFrame:
    """Results that break an invariant: truncated if and only if something is omitted, core if and only if truncated, core with a cost."""
    cut = F.size("omitted") > 0
    return results.where(
        (F.col("truncated") != cut) | ((F.col("coverage") == "core") != F.col("truncated")) | (
            F.col("truncated") & F.col("cost_to_complete").isNull()
        )
    )
