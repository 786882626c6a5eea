"""Captured pages: facts, blocks, verdicts, and results as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.api import sections_of, snapshots
from sheaf.functions.urls import public_url
from sheaf.operators import dom as D
from sheaf.plans.book import Book
from sheaf.plans.captures import read_captures
from sheaf.sources.tables import table

queries = Book()


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def _decoded(part: str) -> str:
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        part = f"regexp_replace({part}, '&{name};?', '{char}', 'g')"
    return part


_ARTICLE = r"regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
PLAIN = _decoded(f"regexp_replace(regexp_replace({_ARTICLE}, '<footer.*?</footer>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")
_TITLE = _decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
_H1 = _decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")


@queries(f"""SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, trim(regexp_replace({_H1}, '\\s+', ' ', 'g')) AS headings,
len(regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+(?:[’''-][\\p{{L}}\\p{{N}}\\p{{M}}_]+)*'))::INT AS words, contains(html, '<article') AS has_container FROM pages""")
def dom_facts(spark, folder):
    rows = D.with_facts(pages(spark, folder), names=("title", "headings", "words", "has_container"))
    return rows.select("page_id", "facts.title", F.array_join("facts.headings", "|").alias("headings"), "facts.words", "facts.has_container")


@queries("""SELECT page_id, contains(lower(html), '<script') AND regexp_matches(lower(html), 'id=["''](app|root)["'']|__next') AS shell FROM pages""")
def script_shell(spark, folder):
    return pages(spark, folder).select("page_id", D.looks_like_shell(F.col("html")).alias("shell"))


_SLUG_H1 = """coalesce(nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(h1), '[^\\x00-\\x7F]', '', 'g'), '[`*_~\\[\\]()]', '', 'g')),
'[^a-z0-9]+', '-', 'g'), '-'), ''), 'section')"""
_SLUG = _SLUG_H1.replace("strip_accents(h1)", f"strip_accents({_H1})")
_WORDS = f"len(regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+(?:[’''-][\\p{{L}}\\p{{N}}\\p{{M}}_]+)*'))"
#: A page's blocks: its heading, then each paragraph, bold where it begins so.
_BLOCKS = f"""b AS (SELECT page_id, 0 AS i, '# ' || trim(regexp_replace({_H1}, '\\s+', ' ', 'g')) AS block FROM pages
UNION ALL SELECT page_id, i, CASE WHEN starts_with(part, '<b>') AND text <> '' THEN '**' || text || '**' ELSE text END FROM (SELECT page_id, i, part,
trim(regexp_replace({_decoded("regexp_replace(regexp_replace(part, '<footer.*$', '', 's'), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(string_split({_ARTICLE}, '<p>')) AS part, unnest(range(len(string_split({_ARTICLE}, '<p>')))) AS i FROM pages) WHERE i > 0) ),
m AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY i) FILTER (block <> '') AS markdown FROM b GROUP BY page_id)"""


@queries(f"""WITH s AS (SELECT page_id, lower({PLAIN}) AS seen, lower(html) AS raw, {_WORDS} AS words, lower(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g'))) AS title,
contains(html, '<article') AS held FROM pages),
t AS (SELECT page_id, len(list_filter(['just a moment', 'attention required', 'access denied', 'security check', 'verify you are human', 'robot or human', 'unusual traffic'],
lambda x: starts_with(title, x))) > 0 AS titled,
len(list_filter(['checking your browser', 'verify you are human', 'complete the security check', 'enable javascript and cookies to continue', 'confirm you are not a robot'],
lambda x: contains(seen, x))) > 0 AS phrase, words, held, raw FROM s),
c AS (SELECT page_id, titled, len(list_filter(['id="challenge-form"', 'cf-chl-', '/cdn-cgi/challenge-platform', 'cf-browser-verification', 'g-recaptcha', 'hcaptcha',
'data-sitekey='], lambda x: contains(raw, x))) > 0 AND (words < 250 OR phrase) OR phrase AND words < 250 AS challenged,
words < 60 AND NOT held AND len(list_filter(['/authwall', 'subscription-wall', 'paywall', 'regwall', 'gateway-content'], lambda x: contains(raw, x))) > 0 AS stub FROM t)
SELECT page_id, titled OR challenged OR stub AS detected, stub AS auth_required FROM c""")
def block_signal(spark, folder):
    rows = D.with_facts(pages(spark, folder), names=D.BLOCK_FACTS)
    return rows.select(
        "page_id", D.block_signal(F.col("html"), F.col("facts"), F.lit(200), F.col("url")).alias("b")
    ).select("page_id", "b.detected", "b.auth_required")


@queries(f"""SELECT page_id, regexp_replace(url, '^(https?)://(?:[^/@]*@)?([^/?#]*)([^?#]*).*$', '\\1://\\2\\3') AS canonical, len(regexp_extract_all(html,
'application/ld\\+json'))::INT AS json_ld, len(regexp_extract_all(html, 'application/(atom|rss)\\+xml'))::INT AS feeds,
regexp_matches(html, 'class="(pagination|pager)"|rel="next"') AS paginated, nullif(regexp_extract(html, 'name="wordcount" content="(\\d+)"', 1), '')::BIGINT AS declared,
nullif(regexp_extract(html, 'http-equiv="refresh" content="[^"]*url=([^"]*)"', 1), '') AS redirect,
nullif(regexp_extract(html, 'name="citation_doi" content="([^"]*)"', 1), '') AS doi, trim(regexp_replace({_H1}, '\\s+', ' ', 'g')) AS paper_title FROM pages""")
def page_probe(spark, folder):
    rows = D.with_facts(pages(spark, folder), names=("canonical", "json_ld", "feeds", "paginated", "declared", "redirect", "doi", "paper_title"))
    return rows.select(
        "page_id", public_url(F.col("facts.canonical")).alias("canonical"), F.size("facts.json_ld").alias("json_ld"),
        F.size("facts.feeds").alias("feeds"), "facts.paginated", "facts.declared", "facts.redirect", "facts.doi", "facts.paper_title"
    )


@queries(f"WITH {_BLOCKS} SELECT page_id, markdown FROM m")
def page_markdown(spark, folder):
    return D.with_facts(pages(spark, folder), names=("markdown",)).select("page_id", "facts.markdown")


def captured(spark: SparkSession, folder: str) -> DataFrame:
    return read_captures(pages(spark, folder).withColumn("fetched_at", F.lit("2024-01-01T00:00:00+00:00")), budget=400)


@queries(f"""WITH {_BLOCKS}, w AS (SELECT page_id, {_WORDS} AS words, regexp_replace(url, '^(https?)://(?:[^/@]*@)?([^/?#]*)([^?#]*).*$', '\\1://\\2\\3') AS url, {_H1} AS h1
FROM pages),
j AS (SELECT w.*, markdown, CASE WHEN words >= 100 THEN 'true' END AS covered, ceil(strlen(markdown) / 4.0) > 400 AS truncated FROM w JOIN m USING (page_id))
SELECT page_id, url, CASE WHEN words >= 100 THEN 'complete' ELSE 'unknown' END AS status, CASE WHEN words >= 100 THEN 'Independent signals agree'
ELSE 'There is too little independent evidence' END AS reason, truncated,
CASE WHEN truncated THEN {_SLUG_H1} ELSE '' END AS omitted,
'heading_presence=true,dom_vs_output_coverage' || coalesce('=' || covered, '') || ',blockpage_check=true,length_sanity,pagination_coverage' AS evidence FROM j""")
def page_verdict(spark, folder):
    return captured(spark, folder).select(
        "page_id", "url", "status", "reason", "truncated", F.array_join("omitted", "|").alias("omitted"),
        F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["name"], e["passed"].cast("string"))), ",").alias("evidence")
    )


@queries(f"""WITH {_BLOCKS}, w AS (SELECT page_id, url, {_WORDS} AS words, regexp_replace(trim(regexp_replace({_H1}, '\\s+', ' ', 'g')), '\\s*#*$', '') AS heading FROM pages)
SELECT page_id, regexp_replace(url, '^(https?)://(?:[^/@]*@)?([^/?#]*)([^?#]*).*$', '\\1://\\2\\3') AS url, CASE WHEN words >= 100 THEN 'complete' ELSE 'unknown' END AS status,
ceil(strlen(markdown) / 4.0) > 400 AS truncated, heading, ceil(strlen(markdown) / 4.0)::BIGINT AS tokens, CASE WHEN ceil(strlen(markdown) / 4.0) > 400 THEN '' ELSE markdown END AS content
FROM w JOIN m USING (page_id)""")
def result_json(spark, folder):
    """Results as JSON texts, and fields read back from them."""
    kept = ("url", "content", "outline", "status", "evidence", "truncated", "omitted", "coverage")
    rows = captured(spark, folder).select("page_id", F.to_json(F.struct(*kept)).alias("result"))
    get = lambda path: F.get_json_object("result", path)
    return rows.select(
        "page_id", get("$.url").alias("url"), get("$.status").alias("status"), (get("$.truncated") == "true").alias("truncated"),
        get("$.outline[0].heading").alias("heading"), get("$.outline[0].token_count").cast("long").alias("tokens"), get("$.content").alias("content"),
    )


@queries(f"""WITH w AS (SELECT page_id, {_WORDS} AS words FROM pages),
k AS (SELECT unnest(['whole', 'challenge', 'one of several pages', 'declared longer']) AS kind),
s AS (SELECT kind, CASE kind WHEN 'whole' THEN CASE WHEN words >= 100 THEN 'complete' ELSE 'unknown' END WHEN 'one of several pages' THEN 'incomplete' ELSE 'unknown' END AS status FROM w, k)
SELECT kind, count(*) AS captures, avg(CASE WHEN status = 'complete' THEN 1.0 ELSE 0.0 END) AS complete FROM s GROUP BY kind""")
def false_complete_rate(spark, folder):
    """Each page whole and in three forms that lack something, and the share of captures that the read calls complete: of the last three none may be."""
    forms = {
        "whole": F.col("html"),
        "challenge": F.lit("<html><head><title>Just a moment...</title></head><body>wait</body></html>"),
        "one of several pages": F.concat("html", F.lit('<div class="pagination"><a href="?page=2">2</a></div>')),
        "declared longer": F.concat(F.lit('<meta name="wordcount" content="1000000">'), F.col("html")),
    }
    made = F.array(*(F.struct(F.lit(k).alias("kind"), h.alias("html")) for k, h in forms.items()))
    rows = pages(spark, folder).select("url", F.explode(made).alias("m")).select("url", "m.kind", "m.html")
    found = read_captures(rows).groupBy("kind")
    return found.agg(F.count("*").alias("captures"), F.avg(F.when(F.col("status") == "complete", 1.0).otherwise(0.0)).alias("complete"))


@queries(f"""WITH p AS (SELECT page_id, sha256(url || chr(10) || html) AS handle, {_SLUG} AS anchor FROM pages),
w AS (SELECT handle, anchor, NULL AS error FROM p UNION SELECT handle, 'no-such-section', 'the page has no such section' FROM p UNION SELECT 'no-' || handle, anchor, 'the handle is not known' FROM p)
SELECT handle, anchor, error FROM w""")
def snapshot_lookup(spark, folder):
    """The first section of each stored page, a section that it lacks, and one behind a handle that nobody gave out."""
    stored = snapshots(pages(spark, folder))
    heads = D.with_facts(stored, names=("sections",)).select("handle", F.get("facts.sections", 0)["anchor"].alias("anchor"))
    wanted = heads.unionByName(heads.withColumn("anchor", F.lit("no-such-section"))).unionByName(heads.withColumn("handle", F.concat(F.lit("no-"), "handle")))
    return sections_of(stored, wanted).select("handle", "anchor", "error")
