"""Hostile pages, the tier ladder, filings, videos, threads at several front ends, opt-in sites and works, each end to end."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf import api, cli
from sheaf.functions import text as X
from sheaf.operators import dom as D
from sheaf.operators import manifests as M
from sheaf.operators import outline as O
from sheaf.operators import recipes
from sheaf.operators import verdict as V
from sheaf.operators.recipes import Recipe
from sheaf.plans.captures import followed, read_captures, violations
from sheaf.plans.filings import filing_records
from sheaf.plans.ladder import read_ladder
from sheaf.plans.routed import best_threads, opt_in_records, read_routed
from sheaf.plans.scholarly import read_works
from sheaf.plans.videos import TRACKS, video_records
from sheaf.sources.captures import as_text, html_files, service_documents
from sheaf.streaming.captures import latest_status

HOSTILE = [
    "<div>" * 2000 + "x",
    "<b>" * 2000 + "x",
    "<ul><li>x" * 2000,
    '<script type="application/ld+json">' + "[" * 100000 + "</script>x",
    f'<meta name="wordcount" content="{"9" * 30}">x',
    f'<meta name="wordcount" content="{"9" * 5000}">x',
    '<a rel="next" href="?page=²">next</a>x',
    "<![foo[bar]]><p>x",
    None,
]
LONG = " ".join(f"word{k}" for k in range(300))
ARTICLE = f"<html><head><title>T</title></head><body><main><h1>Head</h1><p>{LONG}</p><h2>More</h2><p>{LONG}</p></main></body></html>"
WALL = "<html><head><title>Just a moment...</title></head><body>checking your browser</body></html>"
SHELL = '<html><body><script>x()</script><div id="root"></div><p>few words</p></body></html>'
SIGN_IN = '<html><body><div class="paywall"><form action="/login"></form></div>subscribe to continue reading</body></html>'


def test_no_page_ends_a_job(spark):
    rows = spark.createDataFrame([(i, "https://h.org/a", h) for i, h in enumerate(HOSTILE)], "id int, url string, html string")
    found = {r["id"]: r for r in read_captures(rows, budget=50).collect()}
    assert sorted(found) == list(range(len(HOSTILE)))
    assert all(r["error"] is None for r in found.values()) and "x" in found[0]["content"] and found[4]["status"] != "complete"




def test_a_page_that_cannot_be_parsed_is_an_error(monkeypatch):
    tree = D.Tree

    def broken(html):
        if html:
            raise RuntimeError("broken")
        return tree(html)

    monkeypatch.setattr(D, "Tree", broken)
    found = D.page_facts("<p>x", "https://h.org/")
    assert found["error"] == "the page can't be read: RuntimeError" and found["words"] == 0 and found["canonical"] == "https://h.org/"


def test_markdown_keeps_nesting():
    page = "<main><ul><li>one<ul><li>two<pre>a\nb</pre></li></ul></li></ul><blockquote><p>p</p><ol><li>q</li></ol></blockquote><p><a href='/u'><b>t</b></a> <code>c</code></p></main>"
    assert D.page_facts(page, "u", ("markdown",))["markdown"] == "- one\n  - two\n    ```\n    a\n    b\n    ```\n\n> p\n>\n> 1. q\n\n[**t**](/u) `c`"


@pytest.mark.parametrize(
    ("current", "href", "expected"),
    [
        ("https://h.org/a", "?page=2", True),
        ("https://h.org/a", "?page=0", False),
        ("https://h.org/a?q=1", "?page=2", False),
        ("https://h.org/a/1", "/a/2", True),
        ("https://h.org/a", "/a/page/3", True),
        ("https://h.org/a.html", "/a-2.HTML", True),
        ("https://h.org/a.html", "/b-2.html", False),
        ("https://h.org/a", "https://other.org/a?page=2", False),
        ("https://h.org/", "/2", False),
    ],
)
def test_pages_of_one_document(current, href, expected):
    assert D.another_page(current, href) is expected


def test_facts_are_only_those_asked_for(spark):
    rows = spark.createDataFrame([("<title>a</title>", "u")], "html string, url string")
    assert D.with_facts(rows, names=("title", "words")).schema["facts"].dataType.fieldNames() == ["title", "words"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a\n# H\nb\n## I\n", [("Document", 0, "a\n"), ("H", 1, "# H\nb\n"), ("I", 2, "## I\n")]),
        ("# H\n```\n# no\n~~~\n```\n# I", [("H", 1, "# H\n```\n# no\n~~~\n```\n"), ("I", 1, "# I")]),
        ("~~~~\n# no\n~~~\n\n# H #\n", [("Document", 0, "~~~~\n# no\n~~~\n\n"), ("H", 1, "# H #\n")]),
        ("```\n# open to the end\n", [("Document", 0, "```\n# open to the end\n")]),
        ("\n \n# H", [("H", 1, "# H")]),
        ("  \n", [("Document", 0, "  \n")]),
        ("#no\n####### no\n#\n# \n$1 \\ x", [("Document", 0, "#no\n####### no\n#\n# \n$1 \\ x")]),
    ],
)
def test_sections_are_cut_outside_fences(spark, text, expected):
    rows = O.sections(spark.createDataFrame([(1, text)], "doc int, markdown string")).orderBy("pos").collect()
    assert [(r["heading"], r["level"], r["markdown"]) for r in rows] == expected


def test_many_sections_are_cut_in_proportion_to_the_text(spark):
    text = "".join(f"# Heading {k}\nsome text\n```\n# code\n```\n" for k in range(20000))
    found = O.sections(spark.createDataFrame([(1, text)], "doc int, markdown string")).agg(F.count("*"), F.sum(F.length("markdown"))).first()
    assert tuple(found) == (20000, len(text))


def test_ladder_takes_the_tier_that_counts(spark):
    rows = [
        ("plain", 1, ARTICLE, 200, None, {}),
        ("shell", 1, SHELL, 200, None, {}),
        ("shell", 2, ARTICLE, 200, None, {"X-Render-Ms": "900"}),
        ("blocked", 1, WALL, 403, None, {}),
        ("blocked", 2, WALL, 403, None, {}),
        ("asks", 1, SHELL, 200, None, {}),
        ("wall", 1, SIGN_IN, 200, None, {}),
        ("wall", 4, ARTICLE, 200, None, {}),
        ("expired", 1, SIGN_IN, 200, None, {}),
        ("expired", 4, "", 200, None, {}),
        ("lost", 1, None, None, "no route", {}),
        ("gone", 1, "<p>not here</p>", 404, None, {}),
        ("cut", 1, ARTICLE, 200, None, {"x-capture-truncated": "true"}),
        ("policy", 1, SIGN_IN, 200, None, {}),
        ("policy", 4, WALL, 200, None, {"x-capture-policy": "blocked"}),
    ]
    made = [(f"https://h.org/{u}", t, h, s, {"kind": "retrieval", "message": e} if e else None, x) for u, t, h, s, e, x in rows]
    table = spark.createDataFrame(made, "url string, tier int, html string, http_status int, error struct<kind:string,message:string>, headers map<string,string>")
    found = {r["url"].rpartition("/")[2]: r for r in read_ladder(table, budget=200).collect()}
    assert {k: r["provenance"]["tier"] for k, r in found.items()} == {"plain": 1, "shell": 2, "blocked": 1, "asks": 1, "wall": 4, "expired": 1, "lost": 1, "gone": 1, "cut": 1, "policy": 1}
    assert {k: r["next_tier"] for k, r in found.items() if r["next_tier"]} == {"asks": 2, "blocked": 4, "cut": 4}
    assert [found[k]["status"] for k in ("plain", "shell", "wall", "cut", "expired", "lost")] == ["complete", "complete", "complete", "incomplete", "unknown", "unknown"]
    assert found["lost"]["error"]["kind"] == "retrieval" and found["gone"]["error"]["message"] == "the status is 404"
    assert found["shell"]["completion"]["estimated_latency_ms"] == 900 and found["plain"]["completion"] is None
    assert found["expired"]["content"] == "" and ("browser_policy", False) in [(e["name"], e["passed"]) for e in found["policy"]["evidence"]]
    closed = read_ladder(table.where("tier = 1"), required=F.col("url").endswith("plain")).where("url like '%plain'").first()
    assert (closed["content"], closed["status"], closed["next_tier"], closed["structured_data"]) == ("", "unknown", 4, None)


FILING = "<html><body><main><ix:header><p>Item 4. hidden</p></ix:header><p>FORM 10-Q</p><h2>Item 1. A</h2><p>x</p><h2>ITEM 2. B</h2><p>x</p><h2>Item 3</h2>{}</main></body></html>"


def test_filings_are_held_against_their_index(spark):
    whole, part = FILING.format("<h2>Item 4</h2><p>y</p>"), FILING.format("")
    base = "https://www.sec.gov/Archives/edgar/data/1/2/"
    rows = spark.createDataFrame([(f"{base}{n}.htm", h) for n, h in (("whole", whole), ("part", part), ("short", whole), ("open", whole), ("other", "<p>FORM 8-K</p>"))], "url string, html string")
    items = [{"name": "whole.htm", "size": str(len(whole))}, {"name": "part.htm", "size": len(part)}, {"name": "short.htm", "size": "7"}, {"name": "open.htm", "size": ""}]
    index = spark.createDataFrame([(f"{base}index.json", json.dumps({"directory": {"item": items}}))], "url string, document string")
    found = {r["url"].rpartition("/")[2]: r for r in filing_records(rows, index).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"whole.htm": "complete", "part.htm": "incomplete", "short.htm": "incomplete", "open.htm": "unknown", "other.htm": "unknown"}
    assert "hidden" not in found["part.htm"]["content"] and found["part.htm"]["reason"].endswith(": 4")
    assert {r["status"] for r in filing_records(rows).where("url like '%whole%'").collect()} == {"unknown"}


def test_required_items_and_conditions_are_the_published_ones(spark):
    row = spark.range(1).select(M.expected_items(F.lit("10-K")).alias("k"), M.expected_items(F.lit("10-Q")).alias("q"), M.expected_items(F.lit("8-K")).alias("o"), *(M.condition_label(F.lit(c)).alias(c.strip() or "blank") for c in ("used_like_new", "NEW_ITEM", "PC_USED_FAIR", "USED", "PC_FOR_PARTS", ""))).first()
    assert row["k"] == "1 1A 2 3 4 5 7 7A 8 9 9A 10 11 12 13 14".split() and row["q"] == ["1", "2", "3", "4"] and row["o"] is None
    assert [row[c] for c in ("used_like_new", "NEW_ITEM", "PC_USED_FAIR", "USED", "PC_FOR_PARTS", "blank")] == ["Used - Like New", "New", "Used - Fair", "Used", "For Parts", None]


def test_body_profile_leaves_page_matter_out(spark):
    text = "# P\n\n## 1 Introduction\n\na b c\n\n## Access options\n\nx x\n\n## Comments\n\nx\n\n### 2.1 C reactive protein\n\nd e\n\n## Empty\n\n## Acknowledgement\n\nz z z z\n\n## Methods\n\nq"
    row = spark.range(1).select(V.body_profile(V.paper_sections(F.lit(text))).alias("p"), X.scholarly_heading(F.lit("C reactive")).alias("h")).first()
    assert (row["p"]["sections"], row["p"]["words"], row["h"]) == (["1 Introduction", "2.1 C reactive protein"], 5, "c reactive")


def test_videos_need_title_and_captions(spark):
    url = "https://www.youtube.com/watch?v="
    ids = ["a" * 11, "b" * 11, "c" * 11, "d" * 11]
    info = json.dumps({"title": "T", "description": "D", "chapters": [{"start_time": 61.4, "title": "C"}], "view_count": 5})
    rows = spark.createDataFrame([(url + i, "{}" if i[0] == "c" else info) for i in ids] + [("https://youtu.be/x", info)], "url string, html string")
    tracks = spark.createDataFrame([(ids[0], 0, "en", True, ["made"], None), (ids[0], 1, "en", False, [" by ", "", "hand"], None), (ids[1], None, None, None, None, None), (ids[2], 0, "en", True, ["x"], None)], TRACKS)
    found = {r["url"] + str(k): r for k, r in enumerate(video_records(rows, tracks, 1000).collect())}
    by = {json.loads(r["structured_data"]["json_ld"][0]).get("video_id"): r for r in found.values()}
    assert {k: r["status"] for k, r in by.items()} == {ids[0]: "complete", ids[1]: "incomplete", ids[2]: "incomplete", ids[3]: "unknown", None: "unknown"}
    assert by[ids[0]]["content"] == "# T\n\n## Description\n\nD\n\n## Chapters\n\n- 61s: C\n\n## Transcript\n\nby hand" and by[None]["error"]["kind"] == "policy"
    assert video_records(rows).where("status = 'complete'").isEmpty()


def thread_page(count, bodies, more=""):
    return f"<html><body><main><h1>T</h1><p>{count} comments</p>" + "".join(f'<div class="comment" id="c{k}"><p class="comment_score">{k}</p><div class="comment_body"><p>{b}</p></div></div>' for k, b in enumerate(bodies)) + more + "</main></body></html>"


def test_threads_pass_over_front_ends_that_fail(spark):
    deeper = '<a class="deeper_replies">more</a>'
    rows = [
        ("one", 1, WALL, 200, None),
        ("one", 2, thread_page(5, ["a"], deeper), 200, None),
        ("one", 3, thread_page(2, ["a", "b"]), 200, None),
        ("one", 4, thread_page(3, ["a", "b", "c"]), 200, None),
        ("two", 1, thread_page(9, ["a"]), 200, None),
        ("two", 2, thread_page(9, ["a", "b"]), 200, None),
        ("none", 1, thread_page(2, ["a", "b"]), 503, None),
        ("none", 2, thread_page(2, []), 200, None),
        ("none", 3, None, None, {"kind": "retrieval", "message": "lost"}),
    ]
    made = [(f"https://old.reddit.com/r/x/comments/{u}", i, h, s, e) for u, i, h, s, e in rows]
    table = spark.createDataFrame(made, "url string, instance int, html string, http_status int, error struct<kind:string,message:string>")
    found = {r["url"].rpartition("/")[2]: r for r in best_threads(table).collect()}
    counts = {k: json.loads(r["structured_data"]["json_ld"][0])["captured_comment_count"] if r["structured_data"] else None for k, r in found.items()}
    assert {k: (r["status"], counts[k]) for k, r in found.items()} == {"one": ("complete", 2), "two": ("incomplete", 2), "none": ("unknown", None)}
    assert [e["passed"] for e in found["none"]["evidence"]] == [False] * 3


def test_opt_in_sites_fail_closed(spark):
    rows = spark.createDataFrame([("https://www.linkedin.com/company/x", ARTICLE, 1), ("https://www.linkedin.com/in/x", ARTICLE, 1), ("https://www.linkedin.com/in/y", ARTICLE, 4)], "url string, html string, tier int")
    assert {r["status"] for r in opt_in_records(rows).collect()} == {"unknown"} and all(r["content"] == "" for r in opt_in_records(rows, opted_in=True).collect())
    found = {r["url"].partition(".com/")[2]: r for r in opt_in_records(rows, opted_in=True, profiles=("linkedin.com",)).collect()}
    assert {k: bool(r["content"]) for k, r in found.items()} == {"company/x": True, "in/x": False, "in/y": True}
    assert found["in/x"]["evidence"][0]["name"] == "opt_in_policy" and "signed in" in found["in/x"]["reason"]


def section(title, words):
    return f"<sec><title>{title}</title><p>{' '.join(['word'] * words)}</p></sec>"


JATS = "<article><front><article-title>Deep nets at work</article-title><contrib><surname>Li</surname></contrib></front><body>" + section("Introduction", 400) + section("Methods", 500) + "</body><back><ref-list>" + "<ref>r</ref>" * 9 + "</ref-list></back></article>"


def test_works_are_read_from_the_first_rung_that_proves_itself(spark):
    doi = "10.1234/x"
    openalex = {"doi": f"https://doi.org/{doi}", "title": "Deep nets at work", "authorships": [{"author": {"display_name": "Jet Li"}}], "referenced_works_count": 10, "ids": {"pmcid": "https://www.ncbi.nlm.nih.gov/pmc/articles/77"}, "abstract_inverted_index": {"short": [1], "A": [0]}, "locations": [{"pdf_url": "https://h.org/a.pdf", "landing_page_url": "https://repo.org/1"}]}
    crossref = {"message": {"DOI": doi, "title": ["Other"], "reference-count": 9}}
    services = spark.createDataFrame([(doi, "openalex", json.dumps(openalex)), (doi, "crossref", json.dumps(crossref)), ("10.9999/none", "crossref", "not json")], "key string, service string, document string")
    works = spark.createDataFrame([(1, f"https://doi.org/{doi}", None), (2, "https://doi.org/10.9999/none", None), (3, "https://journals.plos.org/x/article/1", "<html><body><main><h1>Page</h1><p>text</p></main></body></html>"), (4, "https://journals.plos.org/x/article/2", f'<html><head><meta name="citation_doi" content="{doi}"></head><body></body></html>')], "id int, url string, html string")
    jats_url = "https://www.ebi.ac.uk/europepmc/webservices/rest/PMC77/fullTextXML"
    bodies = spark.createDataFrame([(jats_url, bytearray(JATS.encode())), ("https://h.org/a.pdf", bytearray(b"no pdf"))], "url string, payload binary")
    found = {r["id"]: r for r in read_works(works, services, bodies).collect()}
    record = {k: json.loads(r["structured_data"]["json_ld"][0]) for k, r in found.items()}
    assert {k: (r["status"], r["content_level"]) for k, r in found.items()} == {1: ("complete", "full_text_with_references"), 2: ("incomplete", "metadata_only"), 3: ("incomplete", "metadata_only"), 4: ("complete", "full_text_with_references")}
    assert found[1]["content"].startswith("# Deep nets at work") and record[1]["acquired"] == {"rung": 1, "provider": "europe-pmc-jats", "kind": "jats"}
    assert record[1]["title"] == "Deep nets at work" and record[1]["abstract"] == "A short" and record[1]["crossref_references"] == 9
    assert found[2]["content"].startswith("# Scholarly work") and found[2]["cost_to_complete"]["estimated_extra_tokens"] == 1000 and record[2]["metadata_failures"] == ["crossref"]
    assert found[3]["content"].startswith("# Page") and found[3]["evidence"][0]["name"] == "scholarly_identifier"
    wrong = spark.createDataFrame([(jats_url, bytearray(JATS.replace("Li<", "Zu<").replace("Deep nets at work", "Quite another thing").encode())), ("https://h.org/a.pdf", bytearray(b"%PDF-1.4"))], "url string, payload binary")
    tries = json.loads({r["id"]: r for r in read_works(works, services, wrong).collect()}[1]["structured_data"]["json_ld"][0])["attempts"]
    assert [(a["rung"], a["detail"]) for a in tries][:1] == [(1, "its front matter is not that of the work")] and (4, "no text could be read") in [(a["rung"], a["detail"].split(";")[0].replace("there is no readable text", "no text could be read")) for a in tries]


def test_routed_results_keep_every_capture(spark):
    urls = ["https://www.sec.gov/Archives/edgar/data/1/2/a.htm", "https://www.youtube.com/watch?v=" + "a" * 11, "https://www.linkedin.com/in/x", "https://www.linkedin.com/jobs/1", "https://h.org/"]
    rows = spark.createDataFrame([(u, ARTICLE) for u in urls], "url string, html string")
    results = read_routed(rows, budget=100)
    assert results.count() == len(urls) and violations(results).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("https://h.org/a", ARTICLE), ("https://h.org/b", SIGN_IN)], "url string, html string")
    rows.write.parquet(f"{tmp_path}/captures")
    assert cli.main([f"{tmp_path}/captures", f"{tmp_path}/out", "--json", "--budget", "50"], spark) == 0
    found = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert {r["url"]: r["truncated"] for r in found} == {"https://h.org/a": True, "https://h.org/b": False}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "one.html").write_text(ARTICLE)
    assert cli.main(["extract", f"{tmp_path}/pages", f"{tmp_path}/extracted", "--url", "https://h.org/"], spark) == 0
    row = spark.read.parquet(f"{tmp_path}/extracted").first()
    assert row["provenance"]["tier"] is None and row["evidence"][-1]["name"] == "supplied_html" and row["url"] == "https://h.org/one.html"
    handles = api.snapshots(rows).select("handle", "url")
    known = {r["url"]: r["handle"] for r in handles.collect()}
    wanted = [(known["https://h.org/a"], "more"), (known["https://h.org/a"], "none"), ("unknown", "more"), (known["https://h.org/a"], "more")]
    spark.createDataFrame(wanted, "handle string, anchor string").write.parquet(f"{tmp_path}/wanted")
    cli.main(["section", f"{tmp_path}/captures", f"{tmp_path}/wanted", f"{tmp_path}/sections"], spark)
    errors = {(r["handle"] == "unknown", r["anchor"]): r["error"] for r in spark.read.parquet(f"{tmp_path}/sections").collect()}
    assert errors == {(False, "more"): None, (False, "none"): "the page has no such section", (True, "more"): "the handle is not known"}
    cli.main(["more", f"{tmp_path}/captures", f"{tmp_path}/wanted", f"{tmp_path}/more"], spark)
    assert not spark.read.parquet(f"{tmp_path}/more").first()["truncated"]
    for bad in (["read", f"{tmp_path}/captures", f"{tmp_path}/x", "--budget", "-1"], [f"{tmp_path}/nowhere", f"{tmp_path}/x"], [f"{tmp_path}/captures", f"{tmp_path}/out"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(bad, spark)
        assert stop.value.code
    rows.withColumn("tier", F.lit(1)).write.parquet(f"{tmp_path}/tiers")
    cli.main(["read", f"{tmp_path}/tiers", f"{tmp_path}/closed", "--tiers", "--signed-in"], spark)
    assert {r["content"] for r in spark.read.parquet(f"{tmp_path}/closed").collect()} == {""}


def test_files_over_the_limit_are_results_with_an_error(spark, tmp_path):
    (tmp_path / "a.html").write_text("x" * 100)
    (tmp_path / "b.html").write_text("<p>y</p>")
    found = {r["url"]: r for r in api.extract_files(html_files(spark, str(tmp_path), "https://h.org/", most=50)).collect()}
    assert found["https://h.org/a.html"]["error"]["kind"] == "retrieval" and found["https://h.org/b.html"]["content"] == "y"
    with pytest.raises(TypeError):
        api.extract_html(spark, None, "https://h.org/")


def test_redirects_of_thin_pages_are_followed(spark):
    thin = '<html><head><meta http-equiv="refresh" content="0; url={}"></head><body>moved</body></html>'
    rows = spark.createDataFrame([("https://h.org/a", thin.format("/b")), ("https://h.org/b", thin.format("/c")), ("https://h.org/c", ARTICLE), ("https://h.org/loop", thin.format("/loop"))], "url string, html string")
    assert {r["url"][-1]: r["landed"][14:] for r in followed(rows).collect()} == {"a": "c", "b": "c", "c": "c", "p": "loop"}


def test_slugs_of_any_script(spark):
    given = {"Éa ﬁne ½ ①": "ea-fine-12-1", "Ｆｕｌｌ": "full", "日本": "section", "Straße": "strae", "*Bold* `x`": "bold-x"}
    row = spark.range(1).select(*(X.slugify(F.lit(t)).alias(f"s{k}") for k, t in enumerate(given))).first()
    assert list(row) == list(given.values()) and [D.slug(t) for t in given] == list(given.values())
    assert X.tokenizer_backend() == "utf8-bytes/4"


def test_recipes_of_installed_packages_are_loaded_when_asked_for(spark, monkeypatch):
    class Point:
        def __init__(self, loaded):
            self.load = lambda: loaded

    own = Recipe("own", 200, (r"^https://own\.org/",))
    monkeypatch.setattr(recipes, "entry_points", lambda group: [Point(own), Point([Recipe("reddit", 1, (r"never",))])] if group == "sheaf.recipes" else [])
    found = recipes.Registry().discovered()
    rows = spark.createDataFrame([("https://own.org/x",), ("https://www.reddit.com/r/a/comments/b",), ("10.1234/abc",), ("https://gut.bmj.com/content/1",), ("12345",)], "url string")
    assert [r["recipe"] for r in found.routed(rows).collect()] == ["own", "reddit", "academic", "academic", "generic"]
    with pytest.raises(TypeError):
        recipes.Registry().added("no recipe")


def test_hostile_threads_and_listings_are_rows(spark):
    bad = ["<div class='comment'><p class='comment_score'>" + "9" * 500 + "</p><div class='comment_body'>x</div></div>", "<p>" + "9" * 400 + " comments</p>", "<script type='application/json'>marketplace_listing_title" + "[" * 90000 + "</script>"]
    rows = spark.createDataFrame([(u, h) for h in bad for u in ("https://www.reddit.com/r/a/comments/b", "https://www.facebook.com/marketplace/item/7")], "url string, html string")
    assert read_routed(rows).count() == 6


def test_outline_heads_and_texts(spark):
    text = "# One\n\n| a | b |\n| --- | --- |\n\n## Two\n```\nx\n```\n[next](/2)\n"
    rows = O.outline(O.sections(spark.createDataFrame([(1, text)], "doc int, markdown string")))
    head = rows.select(O.rendered_head(F.col("sections"), F.lit(40), O.flags(F.lit(text))).alias("t")).first()["t"]
    assert head.splitlines() == ["# Outline", "", "Approximate tokens: 40", "Content flags: tables, code, pagination", "", "- One [#one] (8 approx. tokens, 32 chars)", "  - Two [#two] (7 approx. tokens, 28 chars)"]
    none = spark.range(1).select(O.rendered_head(F.array().cast("array<struct<heading:string,level:int,anchor:string,token_count:bigint,char_count:int>>"), F.lit(0), O.flags(F.lit("x"))).alias("t")).first()["t"]
    assert none.endswith("Content flags: none\n\n(No sections extracted)")
    result = read_captures(spark.createDataFrame([("https://h.org/a", ARTICLE)], "url string, html string"))
    shown = result.select(as_text(F.col("outline"), F.col("content"), F.col("status")).alias("t")).first()["t"]
    assert "- Head [#head]" in shown and "\n\nCompleteness: complete\n\n# Head" in shown


def test_newest_status_of_each_window(spark):
    rows = [("u", "incomplete", "2024-01-01T00:10:00Z"), ("u", "complete", "2024-01-01T00:50:00Z"), ("u", "unknown", "2024-01-01T01:10:00Z"), ("v", "unknown", "2024-01-01T00:20:00Z")]
    df = spark.createDataFrame([(u, s, (t,)) for u, s, t in rows], "url string, status string, provenance struct<fetched_at:string>")
    found = latest_status(df).orderBy("url", "at").collect()
    assert [(r["url"], r["status"]) for r in found] == [("u", "complete"), ("u", "unknown"), ("v", "unknown")]


def test_service_answers_of_any_kind_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"key": "k", "service": "crossref", "document": {"a": 1}}\nnot json\n{"key": 5}\n')
    found = sorted((r["key"] or "", r["service"] or "", r["document"] or "", r["error"] or "") for r in service_documents(spark, str(tmp_path)).collect())
    assert found == [("", "", "", "not json"), ("5", "", "", ""), ("k", "crossref", '{"a":1}', "")]
