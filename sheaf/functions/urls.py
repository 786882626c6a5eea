"""URL functions as Column expressions. Malformed URLs give null or false, never an error."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_KEYS = ("page", "paged", "p")


def url_parts(url: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment); absent parts are empty."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    return F.struct(
        F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):")).alias("scheme"),
        part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)").alias("netloc"),
        part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)").alias("path"),
        part(r"^[^?#]*\?([^#]*)").alias("query"),
        part(r"#(.*)$").alias("fragment"),
    )


def hostname(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(url_parts(url)["netloc"], "^.*@", ""), r":\d*$", ""))


def is_http_url(url: Column) -> Column:
    """An absolute HTTP or HTTPS URL with a host."""
    p = url_parts(url)
    return F.coalesce(p["scheme"].isin("http", "https") & (p["netloc"] != ""), F.lit(False))


def public_url(url: Column) -> Column:
    """What provenance may show: scheme, host with port, and path; no user, query or fragment."""
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), F.regexp_replace(p["netloc"], "^.*@", ""), p["path"])


def strip_contact(url: Column) -> Column:
    """The URL without query parameters that name a contact."""
    kept = F.filter(F.split(url_parts(url)["query"], "&"), lambda q: ~F.lower(F.substring_index(q, "=", 1)).isin("email", "mailto") & (q != ""))
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def normalize_site(value: Column) -> Column:
    """A site as an HTTP(S) URL with a path; null for other schemes and for URLs with a user."""
    full = F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), value).otherwise(F.concat(F.lit("https://"), value))
    p = url_parts(F.trim(full))
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    return F.when(
        p["scheme"].isin("http", "https") & (p["netloc"] != "") & ~p["netloc"].contains("@"),
        F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]), path)
    )


#: Public suffixes of two labels that the approximate rule knows; all others have one label.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "edu.au", "gov.au", "gov.uk",
    "net.au", "or.jp", "org.au", "org.uk"
)


def registrable_domain(url: Column) -> Column:
    """The domain that a site registers, by a short list of suffixes (approximate); an address is itself."""
    host = F.regexp_replace(hostname(url), r"\.$", "")
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), host).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda q: q != "")


def _key(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def other_pairs(query: Column) -> Column:
    """The query's pairs but those that name a page, sorted."""
    return F.sort_array(F.filter(_pairs(query), lambda q: ~_key(q).isin(*PAGE_KEYS)))


def page_values(query: Column) -> Column:
    return F.transform(F.filter(_pairs(query), lambda q: _key(q).isin(*PAGE_KEYS)), lambda q: F.regexp_replace(q, "^[^=]*=?", ""))


def same_resource_page(current: Column, candidate: Column) -> Column:
    """Whether an absolute URL is another page of the current document.

    It is on the same site, is not the same URL, and differs in page parameters only, ends in ``/n`` or
    ``/page/n`` where the current path does not, or names ``stem-n.ext`` beside ``stem.ext``.
    """
    a, b = url_parts(current), url_parts(candidate)
    here, there = F.regexp_replace(a["path"], "/+$", ""), F.regexp_replace(b["path"], "/+$", "")
    base = lambda p: F.regexp_replace(p, r"/[1-9]\d*$", "")
    pages, same_rest = page_values(b["query"]), other_pairs(a["query"]) == other_pairs(b["query"])
    by_query = (a["path"] == b["path"]) & (F.size(pages) > 0) & F.forall(pages, lambda v: v.rlike(r"^\d+$") & v.rlike("[1-9]")) & same_rest
    by_number = (base(here) != "") & (base(there) == base(here)) & (base(there) != there) & same_rest
    by_segment = F.startswith(
        F.lower(there), F.lower(F.concat(here, F.lit("/page/")))
    ) & F.substr(there, F.length(here) + 7).rlike(r"^[1-9]\d*$") & same_rest
    stem = r"^(.+)(\.[A-Za-z0-9]+)$"
    numbered = r"^(.+)-([2-9]\d*)(\.[A-Za-z0-9]+)$"
    by_stem = here.rlike(stem) & there.rlike(numbered) & (F.regexp_extract(here, stem, 1) == F.regexp_extract(there, numbered, 1)) & (
        F.lower(F.regexp_extract(here, stem, 2)) == F.lower(F.regexp_extract(there, numbered, 3))
    ) & same_rest
    site = b["scheme"].isin("http", "https") & (b["netloc"] != "") & (
        a["scheme"] == b["scheme"]
    ) & (a["netloc"] == b["netloc"]) & (current != candidate)
    return F.coalesce(site & (by_query | by_number | by_segment | by_stem), F.lit(False))


#: The forms of a social network's URLs by class.
LINKEDIN_FORMS = (
    ("profile", r"(?i)/in/[^/?#]+(?:/|[?#]|$)"),
    ("company", r"(?i)/company/[^/?#]+"),
    ("pulse", r"(?i)/pulse/[^/?#]+"),
    ("post", r"(?i)/posts/[^?#]*[-_]activity-[0-9]+"),
    ("post", r"/feed/update/"),
)


def linkedin_class(url: Column) -> Column:
    """profile, company, pulse, post or other, by the first form that fits."""
    found = F.lit("other")
    for kind, form in reversed(LINKEDIN_FORMS):
        found = F.when(url.rlike(form), kind).otherwise(found)
    return found


def video_id(url: Column) -> Column:
    """The 11-character id of a video URL; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|/shorts/|/live/|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def listing_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/marketplace/item/(\d+)", 1), F.lit(""))


def document_name(url: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(F.regexp_replace(url_parts(url)["path"], "/+$", ""), "/", -1)


def sibling(url: Column, name: str) -> Column:
    """The URL of another document in the same folder."""
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["netloc"], F.regexp_replace(p["path"], "[^/]*$", ""), F.lit(name))


def redlib_url(url: Column, instance: Column) -> Column:
    """A discussion's URL on another front end."""
    return F.concat(F.regexp_replace(instance, "/+$", ""), url_parts(url)["path"])


def is_public_host(host: str | None, addresses: list[str] | None) -> bool:
    """Whether a host is a global address, or a name whose known addresses all are. Spellings that clients may take for another address are not."""
    host = (host or "").strip("[]")
    if not host or host == "localhost" or host.endswith(".localhost"):
        return False
    parts = host.split(".")
    numeric = ":" not in host and all(re.fullmatch(r"0x[0-9a-f]+|[0-9]+", p) for p in parts)
    if numeric and not (len(parts) == 4 and all(re.fullmatch(r"0|[1-9][0-9]{0,2}", p) and int(p) < 256 for p in parts)):
        return False
    literal = numeric or ":" in host
    try:
        known = [ipaddress.ip_address(a) for a in ([host] if literal else addresses if addresses is not None else [])]
    except ValueError:
        return False
    return bool(known) and all(a.is_global for a in known)


def is_public_candidate(url: Column, addresses: Column) -> Column:
    """Whether a URL may be fetched: absolute HTTP(S), without user and password, to a public host.

    ``addresses``: array<string>, what the host resolves to. It is a column of the input, as a query never asks
    a name server; a name without known addresses is not public.
    """

    @F.pandas_udf("boolean")
    def public(hosts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([is_public_host(h, None if k is None else list(k)) for h, k in zip(hosts, known, strict=True)], dtype="bool")

    plain = is_http_url(url) & ~F.coalesce(url_parts(url)["netloc"].contains("@"), F.lit(False))
    return plain & public(hostname(url), addresses)
