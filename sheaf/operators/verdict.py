"""Completeness verdicts from facts. Evidence is three-valued: null is indeterminate and never counts as a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import scholarly_heading

#: The bounds of each signal, as (complete from, incomplete up to).
HEADINGS, COVERAGE, LENGTH = (0.90, 0.60), (0.80, 0.60), (0.85, 0.70)
LEAST_DOM_WORDS = 100


def is_true(signal: Column) -> Column:
    return F.coalesce(signal, F.lit(False))


def is_false(signal: Column) -> Column:
    return F.coalesce(~signal, F.lit(False))


def heading_signal(total: Column, represented: Column) -> Column:
    ratio = represented / F.nullif(total, F.lit(0))
    return F.when(total > 0, F.when(ratio >= HEADINGS[0], True).when(ratio <= HEADINGS[1], False))


def coverage_signal(dom_words: Column, output_words: Column) -> Column:
    return F.when(
        dom_words >= LEAST_DOM_WORDS,
        F.when(output_words >= F.ceil(dom_words * F.lit(COVERAGE[0])), True).when(output_words <= F.floor(dom_words * F.lit(COVERAGE[1])), False)
    )


def length_signal(declared: Column, output_words: Column) -> Column:
    return F.when(
        declared.isNotNull(),
        F.when(output_words >= F.ceil(declared * F.lit(LENGTH[0])), True).when(output_words <= F.floor(declared * F.lit(LENGTH[1])), False)
    )


def pagination_signal(paginated: Column, covered: Column) -> Column:
    return F.when(paginated, covered)


def generic_status(heading: Column, coverage: Column, length: Column, blocked: Column, pagination: Column) -> Column:
    """A block is unknown; missing pages or any failed content signal is incomplete; two passed ones are complete."""
    content = (heading, coverage, length)
    failed = is_false(heading) | is_false(coverage) | is_false(length)
    passed = sum((is_true(s).cast("int") for s in content), F.lit(0))
    return F.when(is_true(blocked), "unknown").when(
        is_false(pagination), "incomplete"
    ).when(failed, "incomplete").when(passed >= 2, "complete").otherwise("unknown")


def evidence(**signals: Column) -> Column:
    """array<struct<name, passed>> in the order given."""
    return F.array(*(F.struct(F.lit(n).alias("name"), s.cast("boolean").alias("passed")) for n, s in signals.items()))


def any_failed(signals: Column) -> Column:
    return F.exists(signals, lambda e: is_false(e["passed"]))


def all_passed(signals: Column) -> Column:
    return F.forall(signals, lambda e: is_true(e["passed"]))


def strict_status(signals: Column) -> Column:
    """Filings and videos: any failure is incomplete, all passed are complete, anything else is unknown."""
    return F.when(any_failed(signals), "incomplete").when(all_passed(signals), "complete").otherwise("unknown")


def truncated_capture(status: Column, truncated: Column, blocked: Column) -> Column:
    """A capture known to be cut short is incomplete unless it is a block page."""
    return F.when(is_true(truncated) & ~is_true(blocked), "incomplete").otherwise(status)


def listing_status(title: Column, price: Column, description: Column, condition: Column) -> Column:
    """unknown with neither title, price nor description; complete with all four; else incomplete."""
    core = (title, price, description)
    none = title.isNull() & price.isNull() & description.isNull()
    everything = condition.isNotNull()
    for c in core:
        everything = everything & c.isNotNull()
    return F.when(none, "unknown").when(everything, "complete").otherwise("incomplete")


#: Words a page of a paper has, and the headings of a paper's Markdown.
PAGE_WORDS = 450
PAPER_HEADING = r"(?m)^#{2,6}\s+(.+?)\s*$"


def scholarly_signals(f: dict[str, Column]) -> dict[str, Column]:
    """section, abstract, extent and reference signals from facts.

    ``f``: has_paper, is_pdf, sections, body_words, abstract_words, pages, references, resolved, crossref, openalex,
    and ``all_words`` where PDFs are among them: their body is all their text, as headings may not show in it.
    """
    some = is_true(f["has_paper"])
    abstract = f["abstract_words"]
    beyond = abstract.isNull() | (abstract == 0) | ((f["body_words"] >= abstract + 300) & (f["body_words"] >= abstract * 2.5))
    section = some & (f["sections"] >= 2) & (f["body_words"] >= 500) & beyond
    body = F.when(is_true(f["is_pdf"]), f["all_words"]).otherwise(f["body_words"]) if "all_words" in f else f["body_words"]
    contained = F.when(some & (abstract > 0) & ((body <= abstract + 100) | (body <= abstract * 1.5)), False)
    share = body / (f["pages"] * PAGE_WORDS)
    extent = F.when(some & (f["pages"] > 0), F.when(share >= 0.5, True).when(share < 0.2, False))
    least = F.when((f["crossref"] > 0) & (f["openalex"] > 0), F.least(f["crossref"], f["openalex"]))
    found = F.when(some, f["references"]).otherwise(0)
    refs = F.when(least.isNotNull(), F.when(found >= least * 0.7, True).when(found < least * 0.4, False)).otherwise(F.when(found >= 5, True))
    return {
        "full_text_acquisition": some, "section_manifest": is_true(section), "abstract_containment": contained, "page_extent": extent,
        "reference_manifest": refs
    }


def scholarly_verdict(f: dict[str, Column], s: dict[str, Column]) -> Column:
    """struct(content_level, status): an abstract alone is never complete."""
    pdf = is_true(f["is_pdf"])
    has_body = s["full_text_acquisition"] & ~is_false(s["abstract_containment"]) & (s["section_manifest"] | (pdf & is_true(s["page_extent"])))
    resolved = is_true(f["resolved"]) & (f["references"] > 0)
    level = F.when(
        ~has_body, F.when(f["abstract_words"] > 0, "abstract_only").otherwise("metadata_only")
    ).when(resolved, "full_text_with_references").otherwise("full_text")
    lost_refs = is_false(s["reference_manifest"])
    veto = is_false(s["abstract_containment"]) | is_false(s["page_extent"]) | F.when(
        pdf, lost_refs & (f["references"] == 0)
    ).otherwise(lost_refs | ~s["section_manifest"])
    unsure = s["page_extent"].isNull() & (f["pages"] > 0)
    status = F.when(~has_body, "incomplete").when(veto, "incomplete").when(is_true(unsure), "unknown").when(
        s["section_manifest"] & is_true(s["reference_manifest"]), "complete"
    ).otherwise("unknown")
    return F.struct(level.alias("content_level"), status.alias("status"))


#: Section titles that are not a paper's substance, how such titles begin, and how back matter does.
NOT_SUBSTANTIVE = (
    "abstract",
    "access options",
    "references",
    "bibliography",
    "acknowledgements",
    "acknowledgments",
    "author information",
    "authors and affiliations",
    "corresponding author",
    "ethics declarations",
    "competing interests",
    "additional information",
    "rights and permissions",
    "about this article",
    "cite this article",
    "comments",
    "supplementary information",
    "editorial summary",
    "similar content being viewed by others",
)
PAGE_MATTER = ("access ", "author ", "similar content", "rights ", "ethics ", "competing ", "about this ", "cite this ")
BACK_MATTER = (
    "references",
    "bibliography",
    "acknowledgement",
    "acknowledgment",
    "appendix",
    "appendices",
    "supplementary information",
    "author information",
    "ethics declaration",
    "competing interest",
    "rights and permissions",
    "about this article",
    "cite this article",
)


def begins(text: Column, starts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for start in starts:
        found = found | text.startswith(start)
    return found


def is_substantive(title: Column) -> Column:
    """Whether a section title is of the paper's substance."""
    plain = scholarly_heading(title)
    return ~plain.isin(*NOT_SUBSTANTIVE) & ~begins(plain, PAGE_MATTER) & (plain != "")


def body_profile(sections: Column) -> Column:
    """struct(sections, words) of array<struct<title, words>>: the substantive titles that have words, and their words, until the back matter begins."""
    back = F.array_position(F.transform(sections, lambda x: begins(scholarly_heading(x["title"]), BACK_MATTER)), True)
    whole = F.struct(sections.alias("all"), back.alias("back"))
    main = lambda w: F.filter(w["all"], lambda x, i: ((w["back"] == 0) | (i < w["back"] - 1)) & is_substantive(x["title"]) & (x["words"] > 0))
    told = lambda m: F.struct(
        F.transform(m, lambda x: x["title"]).alias("sections"), F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + x["words"]).alias("words")
    )
    return F.transform(F.transform(F.array(whole), main), told)[0]  # one element each, so that nothing is worked out twice


def paper_sections(markdown: Column) -> Column:
    """array<struct<title, words>> of a paper's Markdown, cut at headings of level two or more."""
    titles = F.regexp_extract_all(markdown, F.lit(PAPER_HEADING), F.lit(1))
    bodies = F.slice(F.split(markdown, PAPER_HEADING), 2, F.size(titles))
    return F.zip_with(
        titles, bodies, lambda t,
        b: F.struct(F.trim(t).alias("title"), F.regexp_count(F.coalesce(b, F.lit("")), F.lit(r"\S+")).cast("bigint").alias("words"))
    )


def missing_headings(dom: Column, markdown_headings: Column, lines: Column) -> Column:
    """DOM headings that no heading and no line of their own represents; duplicates count. All arrays are normalised."""
    known = F.array_union(markdown_headings, lines)
    return F.filter(dom, lambda h: (h != "") & ~F.array_contains(known, h))


def examples(values: Column, most: int = 3) -> Column:
    """The first few, and how many more there are."""
    more = F.size(values) - most
    return F.concat(
        F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")
    )
