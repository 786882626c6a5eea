"""Scalar text functions, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexical words, heading lines and the markup that headings lose.
WORD = r"(?U)[\w]+(?:[’'-][\w]+)*"
HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
MARKUP = r"[`*_~\[\]()]"


def _folded() -> dict[str, str]:
    """What compatibility decomposition leaves in ASCII of each character of the basic plane that it leaves something of."""
    letters = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000)))
    plain = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) for c in letters)
    return {c: p for c, p in plain if p}


FOLDED = _folded()
ONE = {c: p for c, p in FOLDED.items() if len(p) == 1}
#: Characters that become several: ligatures, fractions, numerals and signs of the Latin script.
SEVERAL = {c: p for c, p in FOLDED.items() if len(p) > 1 and (c < "Ā" or "‐" <= c <= "↋" or "ﬀ" <= c <= "ﬆ")}


def normalize_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Lexical words: letters, digits and underscores, joined by apostrophes and hyphens."""
    return F.regexp_count(text, F.lit(WORD))


def count_tokens(text: Column) -> Column:
    """Approximate tokens: a quarter of the UTF-8 bytes, rounded up; nothing for nothing."""
    return F.ceil(F.octet_length(text) / 4).cast("int")


def tokenizer_backend() -> str:
    """How ``count_tokens`` counts: by bytes, as no vocabulary is at hand in every executor."""
    return "utf8-bytes/4"


def slugify(text: Column) -> Column:
    """An anchor: ASCII letters and digits joined by hyphens, ``section`` where nothing is left. Accents and styles are removed, other scripts dropped."""
    wide = text
    for c, plain in SEVERAL.items():
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    wide = F.when(text.rlike(f"[{''.join(SEVERAL)}]"), wide).otherwise(text)
    ascii_only = F.regexp_replace(F.translate(wide, "".join(ONE), "".join(ONE.values())), r"[^\x00-\x7F]", "")
    ascii_only = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(text)
    plain = F.lower(F.regexp_replace(ascii_only, MARKUP, ""))
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def normalize_heading(text: Column) -> Column:
    """A heading without markup, case or punctuation, for comparing."""
    return normalize_space(F.regexp_replace(F.lower(F.regexp_replace(text, MARKUP, "")), r"(?U)[^\w]+", " "))


def scholarly_heading(text: Column) -> Column:
    """A section title without its number, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(text), r"^\d+(?:\.\d+)*\s*", "")))


def parse_positive_int(text: Column) -> Column:
    """The first run of digits, with thousands separators taken out; null where it is not positive."""
    digits = F.regexp_replace(F.regexp_extract(text, r"\d[\d,._ ]*", 0), r"\D", "")
    value = digits.try_cast("bigint")
    return F.when(value > 0, value)


def parse_score(text: Column) -> Column:
    """A displayed score such as ``1,204`` or ``-3.5k``; halves round to even. Null where it is not a number."""
    clean = F.lower(F.regexp_replace(F.trim(text), ",", ""))
    number = F.regexp_extract(clean, r"^([+-]?\d+(?:\.\d+)?)([km]?)$", 1)
    unit = F.regexp_extract(clean, r"^([+-]?\d+(?:\.\d+)?)([km]?)$", 2)
    scale = F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1)
    return F.bround(number.try_cast("double") * scale).cast("bigint")


def status_from_error(text: Column) -> Column:
    """The first HTTP status named in an error text."""
    return F.nullif(F.regexp_extract(text, r"\b([1-5]\d\d)\b", 1), F.lit("")).cast("int")


def page_range(text: Column) -> Column:
    """struct(first, last) of a page range; a single page is both."""
    ends = F.split(text, r"\s*[-–]\s*", 2)
    return F.struct(F.trim(ends[0]).alias("first"), F.trim(F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0])).alias("last"))


def page_extent(first: Column, last: Column) -> Column:
    """How many pages a numeric range has; null where it has letters or runs backwards."""
    a, b = F.when(first.rlike(r"^\d+$"), first).try_cast("int"), F.when(last.rlike(r"^\d+$"), last).try_cast("int")
    return F.when(b >= a, b - a + 1)


#: Words that say nothing about a title.
TITLE_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "using", "via", "with")


def plain_tokens(text: Column) -> Column:
    """The distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def title_tokens(text: Column) -> Column:
    """The distinct ASCII tokens of a title of over two letters, stopwords left out."""
    return F.filter(plain_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*TITLE_STOPWORDS))


#: The names of a paper's sections.
SECTION_NAMES = (
    "abstract", "introduction", "background", "related work", "method", "methods", "materials and methods", "result", "results", "discussion", "conclusion", "conclusions",
    "references", "bibliography", "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments",
)


def promote_headings(text: Column) -> Column:
    """Lines of extracted text that are a section's name alone, with a number before it perhaps, become level-two headings."""
    bare = lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")
    name = lambda line: F.lower(F.regexp_replace(bare(line), r"^\d+(?:\.\d+)*[.)]?\s+", ""))
    lines = F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.when((F.length(bare(x)) <= 120) & name(x).isin(*SECTION_NAMES), F.concat(F.lit("## "), bare(x))).otherwise(x)
    )
    return bare(F.array_join(lines, "\n"))


#: A whole fenced block, to the closing fence of its kind or the text's end, and the place before a heading line.
FENCED = "|".join(rf"^[^\S\n]*+{c}{{3}}(?s:.*?)(?:\n[^\S\n]*+{c}{{3}}[^\n]*+|\z)" for c in "`~")
BEFORE_HEADING = r"(?=[^\S\n]{0,3}#{1,6}[^\S\n]+[^\n])"
#: Stands between sections while a text is cut; nothing else writes it.
BETWEEN = "\x01cut-b1946ac92492d2347c6235b4d2611184\x01"


def cut_at_headings(markdown: Column) -> Column:
    """array<string>: the text before the first heading, then each heading with what follows it; headings in fences are text.

    A fence of the other kind inside a fence is text, too. Patterns walk the text once, so the cost is in
    proportion to its length, whatever the number of lines and sections.
    """
    marked = F.regexp_replace(markdown, rf"(?md)({FENCED})|^{BEFORE_HEADING}", f"$1{BETWEEN}")
    return F.split(F.regexp_replace(marked, f"{BETWEEN}(?!{BEFORE_HEADING})", ""), BETWEEN)


def heading_of(section: Column) -> Column:
    """struct(level, heading) of a section's first line."""
    line = F.substring_index(section, "\n", 1)
    return F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("heading"))


def markdown_headings(markdown: Column) -> Column:
    """The headings of a Markdown text, fenced lines left out."""
    parts = cut_at_headings(markdown)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: normalize_space(heading_of(s)["heading"]))


def first_present(*values: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def ordered_distinct(values: Column) -> Column:
    """Distinct values in the order of their first place."""
    return F.array_distinct(values)
