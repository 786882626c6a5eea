"""Independent manifests: merging metadata services, identity checks, filings and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.identifiers import normalized_pmcid
from sheaf.functions.text import first_present, page_range, plain_tokens, title_tokens


def merged(manifests: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row for each key: of every scalar the first that is not null by ``order``, of every list, of texts or structs, the ordered distinct union.

    A full outer merge of any number of services as one aggregation, so a service that failed is a missing row.
    """
    kinds = dict(manifests.dtypes)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]

    def union(name: str) -> Column:
        rows = F.sort_array(F.collect_list(F.struct(order, name)))
        return F.array_distinct(F.flatten(F.transform(rows, lambda x: F.coalesce(x[name], F.array().cast(kinds[name]))))).alias(name)

    unions = [union(c) for c in lists]
    return manifests.groupBy(key).agg(*firsts, *unions)


def deduplicated(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key by position: an aggregation that combines in the map tasks."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_first")).select(
        *keys, *(F.col(f"_first.`{c}`").alias(c) for c in rest)
    ).select(*rows.columns)


def inverted_text(rows: DataFrame, key: str, index: str) -> DataFrame:
    """(key, text): the words of a map<word, positions> in the order of their positions, equal positions by word. Row-local."""
    placed = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word"))))
    )
    return rows.select(key, F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ").alias("text"))


def identity(front: Column, title: Column, authors: Column, bound: Column) -> Column:
    """struct(author_ok, overlap, accepted): whether a text's first 8,000 characters are of the work a manifest names.

    A bound candidate came from the work's own identifier and is rejected only on clear disagreement; an
    unbound one needs an author and most of the title.
    """
    tokens = title_tokens(F.substring(front, 1, 8000))
    wanted = title_tokens(title)
    names = plain_tokens(F.substring(front, 1, 8000))
    author_ok = F.coalesce(
        F.exists(authors, lambda a: (F.size(plain_tokens(a)) > 0) & (F.size(F.array_except(plain_tokens(a), names)) == 0)), F.lit(False)
    )
    overlap = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens)) / F.size(wanted)).otherwise(0.0)
    named = F.coalesce(F.size(authors) > 0, F.lit(False))
    blank = F.coalesce(F.trim(front), F.lit("")) == ""
    accepted = F.when(blank, bound).when(bound, ~(named & ~author_ok & (overlap < 0.4))).otherwise(
        named & author_ok & (F.size(wanted) > 0) & (overlap >= 0.6)
    )
    return F.struct(author_ok.alias("author_ok"), overlap.alias("overlap"), accepted.alias("accepted"))


def missing_items(expected: Column, found: Column) -> Column:
    """Expected items that were not found, in their order."""
    return F.filter(expected, lambda x: ~F.array_contains(found, x))


#: The items that a filing of each form must have.
FILING_ITEMS = {
    "10-K": ("1", "1A", "2", "3", "4", "5", "7", "7A", "8", "9", "9A", "10", "11", "12", "13", "14"),
    "10-Q": ("1", "2", "3", "4"),
}


def expected_items(form: Column) -> Column:
    """The items that a filing of a form must have; null for other forms."""
    known = F.create_map(*(x for k, v in FILING_ITEMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.try_element_at(known, form)


def form_type(html: Column) -> Column:
    """The form that a filing declares, else that its cover names."""
    named = lambda before: F.nullif(F.upper(F.regexp_extract(html, before + r"\s*(10-K|10-Q)\b", 1)), F.lit(""))
    return F.coalesce(named("(?i)<TYPE>"), named(r"(?i)\bFORM\s"))


def filing_items(text: Column) -> Column:
    """The distinct item numbers at the start of lines of a filing's Markdown, headings or not."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*(?:#+\s*)?item\s+([0-9]+[a-z]?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(x)))


#: The codes of a listing's condition.
CONDITIONS = {
    "NEW_ITEM": "New",
    "NEW": "New",
    "USED_LIKE_NEW": "Used - Like New",
    "PC_USED_LIKE_NEW": "Used - Like New",
    "USED_GOOD": "Used - Good",
    "PC_USED_GOOD": "Used - Good",
    "USED_FAIR": "Used - Fair",
    "PC_USED_FAIR": "Used - Fair",
    "USED": "Used",
}


def condition_label(code: Column) -> Column:
    """A condition in words; an unknown code's own words, each with a capital. Null where there is no code."""
    code = F.upper(code)
    known = F.create_map(*(F.lit(x) for kv in CONDITIONS.items() for x in kv))
    return F.coalesce(
        F.try_element_at(known, code), F.nullif(F.initcap(F.lower(F.regexp_replace(F.regexp_replace(code, "^PC_", ""), "_", " "))), F.lit(""))
    )


def listing(fragment: Column) -> Column:
    """struct(title, price, description, location, condition) of one JSON fragment; a field of the wrong type is null."""
    v = F.try_parse_json(fragment)
    get = lambda path: F.try_variant_get(v, path, "string")
    amount = first_present(get("$.listing_price.amount"))
    price = F.coalesce(
        first_present(get("$.formatted_price.text")), F.when(amount.isNotNull(), F.concat_ws(" ", amount, get("$.listing_price.currency")))
    )
    return F.struct(
        first_present(get("$.marketplace_listing_title"), get("$.base_marketplace_listing_title"), get("$.custom_title")).alias("title"),
        F.nullif(F.trim(price), F.lit("")).alias("price"),
        first_present(get("$.redacted_description.text")).alias("description"),
        first_present(get("$.location_text.text")).alias("location"),
        condition_label(first_present(get("$.condition"))).alias("condition"),
    )


def merged_listing(fragments: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, fields): of the fragments about one item the first non-empty value of each field, by position."""
    names = ("title", "price", "description", "location", "condition")
    return fragments.groupBy(key).agg(*(F.min_by(F.col(f"fields.{n}"), F.when(F.col(f"fields.{n}").isNotNull(), F.col(pos))).alias(n) for n in names))


def openalex(document: Column) -> Column:
    """Manifest fields of a work's JSON."""
    v = F.try_parse_json(document)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    names = F.transform(
        F.try_variant_get(v, "$.authorships", "array<variant>"),
        lambda a: F.element_at(F.split(F.trim(F.try_variant_get(a, "$.author.display_name", "string")), r"\s+"), -1)
    )
    return F.struct(
        F.lower(F.regexp_replace(get("$.doi"), "^https?://doi.org/", "")).alias("doi"),
        F.coalesce(get("$.title"), get("$.display_name")).alias("title"),
        F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))).alias("authors"),
        get("$.biblio.first_page").alias("first_page"),
        get("$.biblio.last_page").alias("last_page"),
        get("$.referenced_works_count", "int").alias("reference_count"),
        F.try_variant_get(v, "$.abstract_inverted_index", "map<string,array<int>>").alias("abstract_index"),
        F.array_distinct(
            F.filter(
                F.transform(F.try_variant_get(v, "$.locations", "array<variant>"), lambda x: F.try_variant_get(x, "$.pdf_url", "string")),
                lambda u: u.isNotNull()
            )
        ).alias("pdf_urls"),
        F.array_distinct(
            F.filter(
                F.transform(F.try_variant_get(v, "$.locations", "array<variant>"), lambda x: F.try_variant_get(x, "$.landing_page_url", "string")),
                lambda u: u.isNotNull()
            )
        ).alias("landing_urls"),
        F.nullif(F.regexp_extract(get("$.ids.pmid"), r"(\d+)/*$", 1), F.lit("")).alias("pmid"),
        normalized_pmcid(get("$.ids.pmcid")).alias("pmcid"),
    )


def crossref(document: Column) -> Column:
    """Manifest fields of a registry's JSON."""
    v = F.try_parse_json(document)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    pages = page_range(get("$.message.page"))
    people = F.transform(
        F.try_variant_get(v, "$.message.author", "array<variant>"),
        lambda a: F.coalesce(F.try_variant_get(a, "$.family", "string"), F.try_variant_get(a, "$.name", "string"))
    )
    return F.struct(
        F.lower(get("$.message.DOI")).alias("doi"), get("$.message.title[0]").alias("title"),
        F.array_distinct(F.filter(people, lambda n: n.isNotNull())).alias("authors"), pages["first"].alias("first_page"),
        pages["last"].alias("last_page"), get("$.message.reference-count", "int").alias("reference_count"),
        F.trim(F.regexp_replace(get("$.message.abstract"), "<[^>]*>", " ")).alias("abstract")
    )


def europe_pmc(document: Column, wanted: Column) -> Column:
    """Manifest fields of the first result with the wanted DOI, PubMed or PMC id."""
    rows = F.try_variant_get(F.try_parse_json(document), "$.resultList.result", "array<variant>")
    get = lambda r, path: F.try_variant_get(r, path, "string")
    hit = F.get(
        F.filter(
            rows,
            lambda r: F.coalesce(F.lower(get(r, "$.doi")) == F.lower(wanted), F.lit(False)) | F.coalesce(get(r, "$.pmid") == wanted, F.lit(False)) | F.coalesce(
                F.upper(get(r, "$.pmcid")) == F.upper(wanted), F.lit(False)
            )
        ),
        0
    )
    pages = page_range(get(hit, "$.pageInfo"))
    return F.struct(
        F.lower(get(hit, "$.doi")).alias("doi"), get(hit, "$.title").alias("title"), get(hit, "$.pmid").alias("pmid"),
        get(hit, "$.pmcid").alias("pmcid"), get(hit, "$.abstractText").alias("abstract"), pages["first"].alias("first_page"),
        pages["last"].alias("last_page")
    )


def unpaywall(document: Column) -> Column:
    """array<struct<url, kind>> of open locations: the best first, PDFs before landing pages, each once."""
    v = F.try_parse_json(document)
    rows = F.concat(
        F.array_compact(F.array(F.try_variant_get(v, "$.best_oa_location", "variant"))),
        F.coalesce(F.try_variant_get(v, "$.oa_locations", "array<variant>"), F.array().cast("array<variant>"))
    )
    of = lambda path, kind: F.transform(rows, lambda r: F.struct(F.try_variant_get(r, path, "string").alias("url"), F.lit(kind).alias("kind")))
    return F.array_distinct(F.filter(F.concat(of("$.url_for_pdf", "pdf"), of("$.url_for_landing_page", "landing")), lambda x: x["url"].isNotNull()))


def _collected(document: Column, field: str) -> Column:
    """The first text of a field among the rows of an answer's collection."""
    rows = F.try_variant_get(F.try_parse_json(document), "$.collection", "array<variant>")
    return F.get(
        F.filter(F.transform(rows, lambda r: F.nullif(F.trim(F.try_variant_get(r, f"$.{field}", "string")), F.lit(""))), lambda v: v.isNotNull()), 0
    )


def biorxiv(document: Column) -> Column:
    """The JATS URL that a preprint server gives first."""
    return _collected(document, "jatsxml")


def preprint_doi(document: Column) -> Column:
    """The preprint that a server maps a published work to."""
    return F.lower(_collected(document, "preprint_doi"))
