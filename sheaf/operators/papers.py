"""Scholarly works: rendering JATS, observing Markdown, judging candidates, routes, publisher pages and partial results."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.identifiers import bare_identifier
from sheaf.functions.text import page_extent
from sheaf.functions.urls import hostname, is_http_url
from sheaf.operators.dom import with_facts

MOST_JATS_BYTES = 16 << 20
#: Characters that a page, and one of the article archive's own pages, must show to be a candidate.
LEAST_CHARS, LEAST_ARCHIVE_CHARS = 1_000, 15_000
#: The elements that are rendered as plain paragraphs, and those named by a label and a caption.
PARAGRAPHS, LABELLED = frozenset(("p", "disp-quote", "boxed-text", "statement", "caption")), frozenset(("table-wrap", "fig"))


class Article:
    """Markdown of one JATS document, written while its tags go by.

    Each element whose text is wanted opens a pocket; text goes to every open pocket's buffer by position, so
    the document is walked once and no tree is kept. ``depth`` counts open sections of the body.
    """

    def __init__(self) -> None:
        self.path: list[str] = []
        self.text: list[str] = []
        self.pockets: list[tuple[int, str, int]] = []
        self.title = self.abstract = ""
        self.body: list[tuple[int, str]] = []  # (heading level, or 0 for a block; text)
        self.refs: list[str] = []
        self.lists: list[list[str]] = []
        self.label = self.caption = ""
        self.seen: set[str] = set()
        self.body_at = self.refs_at = self.depth = 0
        self.has_body = False

    def start(self, tag: str, _: dict[str, str]) -> None:
        name = tag.rpartition("}")[2]
        self.path.append(name)
        at = len(self.path)
        first = name not in self.seen
        if name == "body" and first:
            self.body_at = at
            self.pocket("body")
        elif name == "ref-list" and first:
            self.refs_at = at
        elif name in ("article-title", "abstract") and first:
            self.pocket(name)
        elif name == "ref" and self.refs_at:
            self.pocket("ref")
        elif self.inside():
            self.in_body(name, at)
        self.seen.add(name)

    def inside(self) -> bool:
        return bool(self.body_at) and len(self.path) > self.body_at

    def pocket(self, kind: str) -> None:
        self.pockets.append((len(self.path), kind, len(self.text)))

    def in_body(self, name: str, at: int) -> None:
        sections = self.body_at + self.depth
        if name == "sec" and at == sections + 1:
            self.depth += 1
            self.body.append((min(self.depth + 1, 6), ""))
        elif name == "title" and at == sections + 1 and self.depth:
            self.pocket("section title")
        elif at == sections + 1 and name in PARAGRAPHS:
            self.pocket("block")
        elif at == sections + 1 and name == "list":
            self.lists.append([])
            self.pocket("list")
        elif at == sections + 1 and name in LABELLED:
            self.label = self.caption = ""
            self.pocket("labelled")
        elif name == "list-item" and self.lists:
            self.lists[-1].append("")
            self.pocket(f"item {len(self.lists[-1]) - 1}")
        elif name in ("label", "caption") and at == sections + 2 and self.path[-2] in LABELLED:
            self.pocket(name)

    def data(self, text: str) -> None:
        if self.pockets:
            self.text.append(text)

    def end(self, _: str) -> None:
        at = len(self.path)
        while self.pockets and self.pockets[-1][0] == at:
            _, kind, start = self.pockets.pop()
            self.take(kind, " ".join("".join(self.text[start:]).split()))
            if not self.pockets:
                self.text.clear()
        if self.depth and at == self.body_at + self.depth:
            self.depth -= 1
        if at == self.body_at:
            self.body_at = 0
        if at == self.refs_at:
            self.refs_at = 0
        self.path.pop()

    def take(self, kind: str, text: str) -> None:
        if kind == "article-title":
            self.title = text
        elif kind == "abstract":
            self.abstract = text
        elif kind == "body":
            self.has_body = bool(text)
        elif kind == "ref":
            self.refs.append(text)
        elif kind == "section title":
            own = max(i for i, (level, _) in enumerate(self.body) if level)
            if not self.body[own][1]:
                self.body[own] = (self.body[own][0], text)
        elif kind.startswith("item "):
            self.lists[-1][int(kind[5:])] = text
        elif kind == "list":
            self.body.append((0, "\n".join(f"- {t}" for t in self.lists.pop() if t)))
        elif kind == "labelled":
            self.body.append((0, ": ".join(filter(None, (self.label, self.caption)))))
        elif kind in ("label", "caption"):
            setattr(self, kind, getattr(self, kind) or text)
        else:
            self.body.append((0, text))

    def close(self) -> dict[str, Any]:
        if not self.has_body:
            return {"error": "there is no article body"}
        parts, titles = [f"# {self.title or 'Academic paper'}"], []
        if self.abstract:
            parts.append(f"## Abstract\n\n{self.abstract}")
            titles.append("Abstract")
        for level, text in self.body:
            if level:
                titles.append(text or "Section")
            parts.append(f"{'#' * level} {titles[-1]}" if level else text)
        if any(self.refs):
            parts.append("## References\n\n" + "\n".join(f"{i}. {t}" for i, t in enumerate(self.refs, 1) if t))
            titles.append("References")
        text = "\n\n".join(p.strip() for p in parts if p.strip())
        return {
            "markdown": text, "section_titles": titles, "reference_count": len(self.refs), "references_resolved": bool(self.refs),
            "word_count": len(text.split())
        }


NO_PAPER = dict.fromkeys(("markdown", "section_titles", "reference_count", "references_resolved", "word_count", "error"))


def jats(payload: bytes | None) -> dict[str, Any]:
    """Markdown of one JATS document with its sections and references, or an error. Sections may be of any depth."""
    if payload is None or len(payload) > MOST_JATS_BYTES:
        return NO_PAPER | {"error": "no document" if payload is None else "the document is over the limit in bytes"}
    if re.search(rb"<!ENTITY\b", payload, re.I):
        return NO_PAPER | {"error": "entity declarations are not read"}
    try:
        parser = ET.XMLParser(target=Article())
        parser.feed(payload)
        return NO_PAPER | parser.close()
    except (ET.ParseError, ValueError, LookupError) as e:
        return NO_PAPER | {"error": f"not XML: {e}"}


PAPER = "markdown string, section_titles array<string>, reference_count int, references_resolved boolean, word_count int, error string"


def _jats_batch(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jats(p) for p in payloads], columns=[f.split()[0] for f in PAPER.split(", ")])


def with_jats(rows: DataFrame, payload: str = "payload", name: str = "paper") -> DataFrame:
    """Add the struct of ``jats``. Row-local; a payload that can't be read gives an error, never a failed job."""
    return rows.withColumn(name, F.pandas_udf(_jats_batch, PAPER)(F.col(payload).cast("binary")))


def paper_headings(markdown: Column) -> Column:
    """Headings of level two or more, fences not minded."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$"), F.lit(1)), lambda t: F.trim(t))


def bibliography_count(markdown: Column) -> Column:
    """The greatest reference number under the heading of the references; without one, in the last two fifths of the lines."""
    headed = F.split(markdown, r"(?im)^#{1,6}\s+(?:references|bibliography)\s*$", 2)
    under = F.get(F.split(F.get(headed, 1), r"(?m)^#{1,6}\s+\S", 2), 0)
    lines = F.split(F.regexp_replace(markdown, r"\r?\n$", ""), r"\r?\n")
    last = F.array_join(F.filter(lines, lambda _, i: i >= F.floor(F.size(lines) * F.lit(0.6))), "\n")
    tail = F.when(F.size(headed) > 1, under).otherwise(last)
    pattern = F.lit(r"(?m)(?:\[\s*(\d{1,4})\s*\]|^[\s\-*]*(\d{1,4})[.)]\s+\S)")
    numbers = F.concat(F.regexp_extract_all(tail, pattern, F.lit(1)), F.regexp_extract_all(tail, pattern, F.lit(2)))
    return F.coalesce(F.array_max(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: n.cast("int"))), F.lit(0))


def observed(markdown: Column) -> Column:
    """The struct of a paper given as Markdown: its references are seen, not resolved. Blank Markdown is an error."""
    text = F.regexp_replace(markdown, r"^\s+|\s+$", "")
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(~blank, text).alias("markdown"),
        F.when(~blank, paper_headings(text)).alias("section_titles"),
        F.when(~blank, bibliography_count(text)).alias("reference_count"),
        F.when(~blank, F.lit(False)).alias("references_resolved"),
        F.when(~blank, F.regexp_count(text, F.lit(r"\S+"))).alias("word_count"),
        F.when(blank, "there is no readable text").alias("error"),
    )


def papers(rows: DataFrame) -> DataFrame:
    """Add ``paper`` to rows of (kind, payload, url): jats and html are parsed, markdown and the text of PDFs are observed.

    Each kind is its own branch of a union, so a page never goes through the XML parser and neither parser sees text.
    """
    text = F.col("payload").cast("string")
    xml = with_jats(rows.where("kind = 'jats'"))
    page = with_facts(
        rows.where("kind = 'html'").withColumn("_html", text), "_html", names=("markdown",)
    ).withColumn("paper", observed(F.col("facts.markdown")))
    plain = rows.where("kind NOT IN ('jats', 'html')").withColumn("paper", observed(text))
    columns = [*rows.columns, "paper"]
    return xml.select(*columns).unionByName(page.select(*columns)).unionByName(plain.select(*columns))


def candidate(kind: Column, payload: Column, shown: Column, jats_error: Column, least: Column | None = None) -> Column:
    """struct(accepted, reason): whether a captured candidate is what it was advertised as. ``shown``: a page's visible text."""
    floor = F.coalesce(least, F.lit(LEAST_CHARS)) if least is not None else F.lit(LEAST_CHARS)
    magic = F.coalesce(F.hex(F.substring(payload.cast("binary"), 1, 4)) == "25504446", F.lit(False))
    chars = F.length(F.coalesce(shown, F.lit("")))
    accepted = F.when(kind == "pdf", magic).when(kind == "jats", jats_error.isNull()).otherwise(chars >= floor)
    reason = (
        F.when(kind == "pdf", F.when(magic, "it begins as a PDF").otherwise("it does not begin as a PDF"))
        .when(kind == "jats", F.coalesce(jats_error, F.lit("it has an article body")))
        .otherwise(F.concat(chars.cast("string"), F.when(chars >= floor, " visible characters").otherwise(" visible characters are too few")))
    )
    return F.struct(accepted.alias("accepted"), reason.alias("reason"))


#: Hosts that only lead elsewhere, and indexes that describe works without holding them.
REDIRECTORS = ("doi.org", "dx.doi.org", "hdl.handle.net", "handle.net", "n2t.net")
INDEXES = (
    "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "europepmc.org", "openalex.org", "api.openalex.org", "semanticscholar.org",
    "api.semanticscholar.org", "api.crossref.org", "search.crossref.org", "scholar.google.com"
)


def is_publisher_page(url: Column) -> Column:
    host = F.regexp_replace(F.coalesce(hostname(url), F.lit("")), r"^www\.", "")
    return F.coalesce(is_http_url(url), F.lit(False)) & ~host.isin(*REDIRECTORS, *INDEXES)


def publisher_page(landing: Column, doi: Column, locations: Column, original: Column, resolve_doi: bool = True) -> Column:
    """The publisher's page to read: the landing page, the DOI's resolver, an open landing page, the page asked for. null where none is one.

    ``locations``: array<struct<url, kind>>. Without ``resolve_doi`` it is the page that a login could unlock.
    """
    open_page = F.get(F.filter(locations, lambda x: (x["kind"] == "landing") & is_publisher_page(x["url"])), 0)["url"]
    resolver = F.concat(F.lit("https://doi.org/"), F.replace(F.url_encode(doi), F.lit("%2F"), F.lit("/")))
    own = lambda url: F.when(is_publisher_page(url), url)
    return F.coalesce(own(landing), *([F.when(doi != "", resolver)] if resolve_doi else []), open_page, own(original))


#: The paths of works by host. "*." stands for any subdomain.
ARTICLE_PATHS = {
    "academic.oup.com": r"^/[^/]+/article(?:/|$)",
    "arxiv.org": r"^/(?:abs|pdf|html)/[^/]+",
    "biorxiv.org": r"^/content/10\.\d{4,9}/",
    "*.bmj.com": r"^/content/",
    "bmj.com": r"^/content/",
    "cell.com": r"^/[^/]+/(?:fulltext|abstract|pdf)/",
    "chemrxiv.org": r"^/engage/chemrxiv/article-details/",
    "dl.acm.org": r"^/doi/",
    "doi.org": r"^/10\.\d{4,9}/",
    "dx.doi.org": r"^/10\.\d{4,9}/",
    "elifesciences.org": r"^/articles/",
    "europepmc.org": r"^/articles/PMC\d+|^/(?:article|abstract)/(?:MED|PMC)/",
    "frontiersin.org": r"^/journals/[^/]+/articles/",
    "hal.science": r"^/hal-\d+",
    "hdl.handle.net": r"^/10\.\d{4,9}/",
    "ieeexplore.ieee.org": r"^/document/\d+",
    "jamanetwork.com": r"^/journals/[^/]+/(?:fullarticle|articleabstract)/",
    "journals.plos.org": r"^/[^/]+/article(?:/|$)",
    "jstor.org": r"^/stable/",
    "link.springer.com": r"^/article/",
    "linkinghub.elsevier.com": r"^/retrieve/pii/",
    "mdpi.com": r"^/\d{4}-\d{3,4}/\d+/\d+/\d+",
    "medrxiv.org": r"^/content/10\.\d{4,9}/",
    "nature.com": r"^/articles/",
    "ncbi.nlm.nih.gov": r"^/pmc/articles/PMC\d+",
    "nejm.org": r"^/doi/",
    "onlinelibrary.wiley.com": r"^/doi/",
    "openalex.org": r"^/works/",
    "osf.io": r"^/preprints/",
    "pmc.ncbi.nlm.nih.gov": r"^/articles/PMC\d+",
    "pnas.org": r"^/doi/",
    "psyarxiv.com": r"^/[A-Za-z0-9][A-Za-z0-9._-]{4,}/?$",
    "pubmed.ncbi.nlm.nih.gov": r"^/\d{4,10}/?$",
    "researchgate.net": r"^/publication/",
    "sagepub.com": r"^/doi/",
    "science.org": r"^/doi/",
    "sciencedirect.com": r"^/science/article/pii/",
    "semanticscholar.org": r"^/paper/",
    "ssrn.com": r"^/abstract(?:=|/)",
    "tandfonline.com": r"^/doi/",
    "thelancet.com": r"^/journals/[^/]+/article/",
    "zenodo.org": r"^/records?/",
}


def is_article_url(url: Column) -> Column:
    """Whether a URL has the path of a work on a host that holds works. One map lookup by host, then one pattern."""
    decoded = F.coalesce(F.try_url_decode(F.trim(url)), F.trim(url))
    host = F.regexp_replace(F.lower(F.coalesce(hostname(decoded), F.lit(""))), r"^www\.|\.$", "")
    path = F.regexp_replace(F.regexp_extract(decoded, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    known = F.create_map(*(F.lit(x) for kv in ARTICLE_PATHS.items() for x in kv))
    pattern = F.coalesce(F.try_element_at(known, host), F.try_element_at(known, F.regexp_replace(host, r"^.+\.([^.]+\.[^.]+)$", "*.$1")))
    return F.coalesce((path != "") & F.regexp_like(path, F.concat(F.lit("(?i)"), pattern)), F.lit(False))


def is_scholarly_input(value: Column) -> Column:
    """Whether a text is an identifier of a work, digits alone left out, or a work's URL."""
    return bare_identifier(value, digits=False).isNotNull() | is_article_url(value)


def partial_markdown(title: Column, abstract: Column, ids: dict[str, Column]) -> Column:
    """What is known of a work whose text was not found: the abstract, else its identifiers by label."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    lines = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}: "), given(c)) for k, c in ids.items()))), "\n")
    rest = F.coalesce(F.concat(F.lit("## Abstract\n\n"), given(abstract)), F.nullif(lines, F.lit("")), F.lit("Metadata only."))
    return F.concat(F.lit("# "), F.coalesce(given(title), F.lit("Scholarly work")), F.lit("\n\n"), rest)


def full_text_cost(first_page: Column, last_page: Column, abstract: Column) -> Column:
    """Tokens that a work's text would cost: 450 a page, else six for each word of the abstract, 1,000 at least."""
    words = F.regexp_count(F.coalesce(abstract, F.lit("")), F.lit(r"\S+"))
    return F.coalesce(page_extent(first_page, last_page) * 450, F.greatest(F.lit(1000), words * 6)).cast("long")
