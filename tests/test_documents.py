"""JATS, discussion pages, listings and videos."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf.functions import identifiers as I
from sheaf.functions import text as X
from sheaf.functions import urls as U
from sheaf.operators import discussions as T
from sheaf.operators import dom as D
from sheaf.operators import media as M
from sheaf.operators import papers as P

ARTICLE = b"""<article xmlns="urn:x"><front><article-title>On <i>Nets</i></article-title><abstract><p>Short.</p></abstract></front>
<body><p>Lead.</p><sec><title>Methods</title><p>One.</p><sec><p>Deep.</p></sec><list><list-item><p>a</p></list-item><list-item/><list-item><p>b</p></list-item></list></sec>
<sec><title>Results</title><table-wrap><label>T1</label><caption><p>Counts</p></caption></table-wrap></sec></body>
<back><ref-list><ref>First</ref><ref/><ref>Third</ref></ref-list></back></article>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_jats_keeps_nested_sections_and_references():
    found = P.jats(ARTICLE)
    assert found["markdown"] == "# On Nets\n\n## Abstract\n\nShort.\n\nLead.\n\n## Methods\n\nOne.\n\n### Section\n\nDeep.\n\n- a\n- b\n\n## Results\n\nT1: Counts\n\n## References\n\n1. First\n3. Third"
    assert found["section_titles"] == ["Abstract", "Methods", "Section", "Results", "References"]
    assert (found["reference_count"], found["references_resolved"], found["error"]) == (3, True, None)


@pytest.mark.parametrize("payload", [None, b"", b"<a>", b"<article><body> </body></article>", b'<!DOCTYPE a [<!ENTITY x "y">]><article><body>&x;</body></article>'])
def test_unreadable_jats_is_an_error(payload):
    assert P.jats(payload)["error"] and P.jats(payload)["markdown"] is None


def test_deep_jats_is_read_and_levels_stop_at_six():
    found = P.jats(b"<article><body>" + b"<sec>" * 3000 + b"<p>x</p>" + b"</sec>" * 3000 + b"</body></article>")
    assert found["markdown"].endswith("###### Section\n\nx") and "#######" not in found["markdown"]


def test_papers_by_kind(spark):
    page = "<html><body><article><h1>T</h1><h2>Methods</h2><p>Words here.</p></article></body></html>"
    rows = spark.createDataFrame([(1, "jats", bytearray(ARTICLE), "u"), (2, "html", bytearray(page.encode()), "https://x.org/a"), (3, "markdown", bytearray(b" # T\n## A\n## References\n1. a\n2. b\n"), "u"), (4, "pdf", None, "u")], "id int, kind string, payload binary, url string")
    got = {r["id"]: r["paper"] for r in P.papers(rows).collect()}
    assert got[1]["reference_count"] == 3 and got[2]["section_titles"] == ["Methods"]
    assert (got[3]["section_titles"], got[3]["reference_count"], got[3]["word_count"]) == (["A", "References"], 2, 10)
    assert got[4]["error"]


@pytest.mark.parametrize(
    ("text", "count"),
    [("## References\n1. a\n12) b\n## After\n40. c", 12), ("# x\n[3] in text\n\n\n\n\n\n\n[7] a [9] b\n", 9), ("[5] early\n" + "x\n" * 9, 0), ("", 0), ("## Bibliography\n[ 2 ] a", 2)],
)
def test_bibliography_counts(spark, text, count):
    assert one(spark, P.bibliography_count(F.lit(text))) == count


@pytest.mark.parametrize(
    ("url", "wanted"),
    [("https://www.nature.com/articles/x1", True), ("https://nature.com/news/x1", False), ("https://gut.bmj.com/content/1/2", True), ("https://bmj.com/content/1", True), ("https://blogs.bmj.com/x", False), ("https://blast.ncbi.nlm.nih.gov/pmc/articles/PMC1", False), ("https://dx.doi.org/10.1234/x", True), ("ftp://arxiv.org/abs/1", False), ("https://arxiv.org/", False), ("https://ssrn.com/abstract=12", True), ("not a url", False), (None, False)],
)
def test_article_urls(spark, url, wanted):
    assert one(spark, P.is_article_url(F.lit(url).cast("string"))) is wanted


def test_candidates_and_publisher_pages(spark):
    judge = lambda kind, payload, shown="", error=None, least=None: one(spark, P.candidate(F.lit(kind), F.lit(payload), F.lit(shown), F.lit(error).cast("string"), least))["accepted"]
    assert judge("pdf", b"%PDF-1.7") and not judge("pdf", b"<html>") and not judge("jats", b"", error="x") and judge("jats", b"x")
    assert judge("html", b"", "x" * 1000) and not judge("html", b"", "x" * 999) and not judge("html", b"", "x" * 1000, least=F.lit(15_000))
    places = F.array(F.struct(F.lit("https://pub.org/a").alias("url"), F.lit("landing").alias("kind")))
    pick = lambda landing, doi, original, **kw: one(spark, P.publisher_page(F.lit(landing).cast("string"), F.lit(doi).cast("string"), places, F.lit(original).cast("string"), **kw))
    assert pick("https://j.org/1", "10.1/x", None) == "https://j.org/1"
    assert pick("https://www.doi.org/10.1", "10.1234/a b/c", None).startswith("https://doi.org/10.1234/a")
    assert pick("https://europepmc.org/x", "10.1/x", None, resolve_doi=False) == "https://pub.org/a"


def test_partial_results(spark):
    text = one(spark, P.partial_markdown(F.lit(None).cast("string"), F.lit(""), {"DOI": F.lit("10.1/x"), "PMID": F.lit(None).cast("string")}))
    assert text == "# Scholarly work\n\nDOI: 10.1/x"
    assert one(spark, P.full_text_cost(F.lit("10"), F.lit("12"), F.lit("a"))) == 1350
    assert one(spark, P.full_text_cost(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("a " * 500))) == 3000
    assert one(spark, P.full_text_cost(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == 1000


def comment(name, score, body):
    return f'<div class="comment" id="{name}"><a class="comment_author">u{name}</a><p class="comment_score">{score}</p><span class="created" title="2024">1h</span><div class="comment_body"><p>{body}</p></div></div>'


THREAD = "https://www.reddit.com/r/spark/comments/abc1/x/"
PAGE = f"<html><body><main><h1 class='post_title'>Ask - Redlib</h1><p>1,003 comments</p>{comment('a', '5', 'first')}{comment('b', 'Vote', 'no score')}{comment('c', '1.2k', 'top')}{comment('', '5', 'tie')}<div class='comment'></div></main><a class='deeper_replies' href='#'>more</a></body></html>"


def test_threads_are_parsed_ranked_and_judged(spark):
    rows = spark.createDataFrame([(1, THREAD, PAGE), (2, THREAD, None), (3, "https://example.com", PAGE)], "id int, url string, html string")
    got = {r["id"]: r for r in T.thread_results(rows).collect()}
    first = got[1]
    assert first["structured_data"]["reported_comment_count"] == 1003 and first["status"] == "incomplete" and first["structured_data"]["subreddit"] == "spark"
    assert [c["id"] for c in first["structured_data"]["comments"]] == ["c", "a", "captured-4", "b"]
    assert first["content"].startswith("# Ask\n\nSubreddit: r/spark\n\nReported comments: 1003\n\nUnloaded reply subtrees: 1\n\n## Comment c\n\nScore: 1200 | Author: uc | Timestamp: 2024 | Age: 1h\n\n> top")
    assert [s["anchor"] for s in first["outline"]] == ["ask", "comment-c", "comment-a", "comment-captured-4", "comment-b"]
    assert (first["truncated"], first["cost_to_complete"]["remaining_items"], first["cost_to_complete"]["estimated_extra_tokens"]) == (False, 1, 0)
    assert got[2]["status"] == "unknown" and got[2]["structured_data"]["captured_comment_count"] == 0 and got[2]["truncated"] is False
    assert got[3]["status"] == "unknown" and got[3]["content"] == "" and got[3]["cost_to_complete"] is None


def test_thread_budgets_keep_whole_comments(spark):
    rows = spark.createDataFrame([(1, THREAD, PAGE)], "id int, url string, html string")
    whole = T.thread_results(rows).first()["content"]
    blocks = whole.split("\n\n## ")
    tokens = [-(-len(b.encode()) // 4) for b in (blocks[0], *("## " + b for b in blocks[1:]))]
    for kept in range(5):
        for budget, wanted in ((sum(tokens[: kept + 1]), kept), (sum(tokens[: kept + 1]) - 1, kept - 1)):
            got = T.thread_results(rows, budget=budget).first()
            assert len(got["omitted"]) == 4 - max(wanted, 0) and (got["content"] == "") == (wanted < 0)
            assert got["coverage"] == ("core" if got["omitted"] else "full")
    assert T.thread_results(rows, limit=2).first()["omitted"] == ["comment-captured-4", "comment-b"]
    assert T.thread_results(rows, budget=0, limit=2, full=True).first()["omitted"] == []
    for wrong in (True, -1, 1.5):
        with pytest.raises(ValueError):
            T.thread_results(rows, budget=wrong)


def test_listings_merge_their_own_objects(spark):
    own = [{"id": "7", "marketplace_listing_title": "Wheels", "listing_price": {"amount": "9.00", "currency": "USD"}, "condition": "PC_USED_GOOD"}, {"x": [{"id": 7, "marketplace_listing_title": "Other", "formatted_price": {"text": "$9"}, "redacted_description": {"text": " Four. "}, "is_sold": True}]}]
    noise = {"id": "8", "marketplace_listing_title": "Carousel", "location_text": {"text": "Far"}}
    page = f'<script type="application/json">{json.dumps([noise, *own])}</script><script type="application/json">marketplace_listing_title {{</script>'
    rows = spark.createDataFrame([(1, "https://www.facebook.com/marketplace/item/7/", page), (2, "https://www.facebook.com/marketplace/item/9/", page), (3, "https://example.com", None)], "id int, url string, html string")
    got = {r["id"]: r for r in M.listing_results(rows).collect()}
    assert got[1]["content"] == "# Wheels\n\n- **Price:** $9\n- **Condition:** Used - Good\n- **Status:** Sold\n\n## Description\n\nFour." and got[1]["status"] == "complete"
    assert got[2]["status"] == got[3]["status"] == "unknown" and got[2]["content"] == "# Facebook Marketplace listing"


def test_videos(spark):
    track = lambda name, made: F.struct(F.lit(name).alias("text"), F.lit(made).alias("is_generated"))
    assert one(spark, M.chosen_track(F.array(track("a", True), track("b", False))))["text"] == "b"
    assert one(spark, M.chosen_track(F.array(track("a", True))))["text"] == "a"
    chapters = F.array(F.struct(F.lit(2.5).alias("start_time"), F.lit(None).cast("string").alias("title")))
    assert one(spark, M.video_markdown(F.lit(""), F.lit("v1"), F.lit(None).cast("string"), chapters, F.lit("hi"))) == "# v1\n\n## Chapters\n\n- 2s: Untitled\n\n## Transcript\n\nhi"


def test_identifiers_end_at_queries(spark):
    assert tuple(one(spark, I.identifier(F.lit("https://x.org/10.1234/ab?c=1#d")))) == ("doi", "10.1234/ab")
    assert tuple(one(spark, I.identifier(F.lit("PMID : 12345")))) == ("pmid", "12345")
    assert tuple(one(spark, I.identifier(F.lit("PMC123")))) == ("pmcid", "PMC123")


def test_headings_of_extracted_text(spark):
    assert one(spark, X.promote_headings(F.lit(" x\n2.1) Methods \nResults:\nAcknowledgments\n"))) == "x\n## 2.1) Methods\nResults:\n## Acknowledgments"


@pytest.mark.parametrize(("html", "wanted"), [('<meta name="description" content=" a  b "><p class="abstract">c</p>', "a b"), ('<p class="abstract">c</p><div data-title="Abstract">d</div>', "d"), ("<p>x</p>", None)])
def test_abstracts(html, wanted):
    assert D.page_facts(html, "https://x.org")["abstract"] == wanted


def test_read_takes_each_url_by_its_recipe(spark):
    from sheaf import api
    from sheaf.plans.captures import violations

    listed = '<script type="application/json">{"id": "7", "marketplace_listing_title": "Wheels"}</script>'
    page = "<html><body><article><h1>T</h1><h2>A</h2><p>Some words.</p></article></body></html>"
    rows = spark.createDataFrame([(1, THREAD, PAGE), (2, "https://www.facebook.com/marketplace/item/7/", listed), (3, "https://www.linkedin.com/in/x/", page), (4, "https://example.com/a?token=1", page), (5, None, None)], "id int, url string, html string")
    results = api.read(rows, budget=8)
    got = {r["id"]: r for r in results.collect()}
    assert [got[i]["recipe"] for i in range(1, 5)] == ["reddit", "facebook_marketplace", "linkedin", "generic"] and len(got) == 5
    assert (got[1]["content"], got[1]["status"], got[1]["provenance"]["tier"], got[1]["evidence"][0]["passed"]) == ("", "incomplete", 2, False)
    assert (got[2]["content"], got[2]["status"], got[2]["provenance"]["canonical_url"]) == ("# Wheels", "incomplete", "https://www.facebook.com/marketplace/item/7")
    assert (got[3]["content"], got[3]["status"], got[3]["failure"]) == ("", "unknown", "auth")
    assert got[4]["url"] == "https://example.com/a" and got[4]["content"].startswith("# T")
    assert got[5]["status"] == "unknown" and got[5]["error"]["kind"] == "policy"
    assert violations(results).count() == 0


@pytest.mark.parametrize(
    ("url", "addresses", "wanted"),
    [("https://a.org/x", ["93.184.216.34"], True), ("https://a.org/x", ["93.184.216.34", "10.0.0.1"], False), ("https://a.org/x", [], False), ("https://a.org/x", None, False), ("https://a.org/x", ["odd"], False), ("https://8.8.8.8:80/", None, True), ("https://127.0.0.1/", None, False), ("https://010.8.8.8/", None, False), ("https://0x8.8.8.8/", None, False), ("https://134744072/", None, False), ("https://8.8.8.999/", None, False), ("https://[2606:4700::1]/", None, True), ("https://[::1]:8080/", None, False), ("https://u:p@a.org/", ["8.8.8.8"], False), ("https://x.localhost/", ["8.8.8.8"], False), ("ftp://8.8.8.8/", None, False), ("", None, False), (None, None, False)],
)
def test_public_candidates(spark, url, addresses, wanted):
    rows = spark.createDataFrame([(url, addresses)], "url string, addresses array<string>")
    assert rows.select(U.is_public_candidate(F.col("url"), F.col("addresses")).alias("x")).first()["x"] is wanted
