import itertools

import pytest
from pyspark.sql import functions as F

from sheaf import api
from sheaf.functions import identifiers as I
from sheaf.functions import text as X
from sheaf.functions import urls as U
from sheaf.operators import attempts as A
from sheaf.operators import dom as D
from sheaf.operators import manifests as M
from sheaf.operators import outline as O
from sheaf.operators import verdict as V
from sheaf.operators.recipes import Recipe, Registry
from sheaf.plans.captures import read_captures, violations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fences_hide_headings_and_anchors_are_numbered(spark):
    text = "intro\n# Example\n~~~\n# not one\n```\n~~~\n## Example ##\nx\n# Example 2\n"
    rows = O.sections(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "plain")], "doc int, markdown string")).orderBy("doc", "pos").collect()
    assert [(r["doc"], r["heading"], r["level"], r["anchor"]) for r in rows] == [(1, "Document", 0, "document"), (1, "Example", 1, "example"), (1, "Example", 2, "example-2"), (1, "Example 2", 1, "example-2"), (4, "Document", 0, "document")]
    assert "".join(r["markdown"] for r in rows if r["doc"] == 1) == text


@pytest.mark.parametrize(("budget", "kept"), [(0, 0), (3, 0), (4, 1), (8, 2), (9, 2)])
def test_budget_keeps_whole_sections(spark, budget, kept):
    rows = O.sections(spark.createDataFrame([(1, "# One\nabcdefghi\n# Two\nabcdefghi\n")], "doc int, markdown string"))
    assert O.fitted(rows, budget).where("kept").count() == kept


def test_budget_must_be_a_count(spark):
    rows = O.sections(spark.createDataFrame([(1, "# One")], "doc int, markdown string"))
    for wrong in (-1, True, 1.5):
        with pytest.raises(ValueError):
            O.fitted(rows, wrong)


@pytest.mark.parametrize(("given", "wanted"), [("1,204", 1204), ("3.5k", 3500), ("-2", -2), ("1.2.3", None), ("", None), ("2M", 2_000_000)])
def test_scores(spark, given, wanted):
    assert one(spark, X.parse_score(F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Ünïcode `x` [y](z)", "unicode-x-yz"), ("日本", "section"), ("a -- b", "a-b")])
def test_slugs(spark, given, wanted):
    assert one(spark, X.slugify(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "kind", "value"),
    [("arXiv:2101.00001v2", "arxiv", "2101.00001"), ("PMC12345", "pmcid", "PMC12345"), ("PMID 12345", "pmid", "12345"), ("12345", "pmid", "12345"), ("https://doi.org/10.1000%2FABC.", "doi", "10.1000/abc"), ("https://europepmc.org/article/MED/4567", "pmid", "4567")],
)
def test_identifiers(spark, given, kind, value):
    assert tuple(one(spark, I.identifier(F.lit(given)))) == (kind, value)


def test_no_identifier(spark):
    assert one(spark, I.identifier(F.lit("nothing"))) is None


PAGES = [
    ("https://e.com/a", "https://e.com/a?page=2", True),
    ("https://e.com/a?x=1", "https://e.com/a?page=2", False),
    ("https://e.com/a/2", "https://e.com/a/3", True),
    ("https://e.com/a", "https://e.com/a/page/3", True),
    ("https://e.com/a.html", "https://e.com/a-2.html", True),
    ("https://e.com/a", "https://e.com/b", False),
    ("https://e.com/a", "https://f.com/a?page=2", False),
    ("https://e.com/a", "https://e.com/a?page=0", False),
]


@pytest.mark.parametrize(("here", "there", "wanted"), PAGES)
def test_pages_of_one_document(spark, here, there, wanted):
    assert one(spark, U.same_resource_page(F.lit(here), F.lit(there))) is wanted
    assert D.another_page(here, there) is wanted


def test_verdict_bounds(spark):
    cases = [(100, 80, True), (100, 60, False), (100, 61, None), (99, 99, None)]
    for dom, out, wanted in cases:
        assert one(spark, V.coverage_signal(F.lit(dom), F.lit(out))) is wanted


def test_verdict_precedence(spark):
    b = lambda v: F.lit(v).cast("boolean")
    values = (True, False, None)
    rows = [(h, c, n, k, p) for h, c, n in itertools.product(values, repeat=3) for k in (True, False) for p in values]
    df = spark.createDataFrame(rows, "h boolean, c boolean, n boolean, k boolean, p boolean")
    for r in df.withColumn("s", V.generic_status(*(F.col(x) for x in "hcnkp"))).collect():
        content = (r["h"], r["c"], r["n"])
        wanted = "unknown" if r["k"] else "incomplete" if r["p"] is False or False in content else "complete" if content.count(True) >= 2 else "unknown"
        assert r["s"] == wanted
    assert b is not None


def test_an_abstract_is_never_complete(spark):
    grid = itertools.product((True, False), (True, False), (0, 2), (90, 600), (None, 80, 500), (None, 1, 9), (0, 9), (None, 10))
    rows = [(p, f, s, w, a, g, r, r > 1, c, c) for p, f, s, w, a, g, r, c in grid]
    names = ("has_paper", "is_pdf", "sections", "body_words", "abstract_words", "pages", "references", "resolved", "crossref", "openalex")
    df = spark.createDataFrame(rows, "has_paper boolean, is_pdf boolean, sections int, body_words int, abstract_words int, pages int, references int, resolved boolean, crossref int, openalex int")
    own = {n: F.col(n) for n in names}
    out = df.select(V.scholarly_verdict(own, V.scholarly_signals(own)).alias("v")).select("v.*")
    assert out.where("content_level in ('abstract_only', 'metadata_only') and status = 'complete'").count() == 0
    assert out.where("status = 'complete'").count() > 0


ARTICLE = "<html><head><title> My  page </title><link rel='canonical' href='/c?x=1'><script type='application/ld+json'>{\"wordCount\": 120}</script></head><body><nav><a href='/x'>x</a></nav><article><h1>Head</h1>" + "<p>word " * 60 + "<h2>Second</h2><ul><li>one<li>two</ul>" + "<p>more words here</p>" * 20 + "<div hidden>secret</div></article></body></html>"


def test_page_facts():
    f = D.page_facts(ARTICLE, "https://e.com/a")
    assert (f["title"], f["headings"], f["has_container"], f["declared"], f["canonical"]) == ("My page", ["Head", "Second"], True, 120, "https://e.com/c?x=1")
    assert f["words"] == 124 and "secret" not in f["markdown"] and "- one\n- two" in f["markdown"]
    assert D.page_facts(None, None)["words"] == 0


@pytest.mark.parametrize(
    ("html", "status", "wanted", "auth"),
    [
        (ARTICLE, 200, False, False),
        ("<title>Just a moment...</title><body>wait</body>", 200, True, False),
        ("<body><div class='paywall'>Subscribe to continue reading</div></body>", 200, True, True),
        ("<body><article><div class='paywall' hidden>x</div>fine</article></body>", 403, True, False),
        ("<body>we value consent <b>accept all</b></body>", 200, True, False),
    ],
)
def test_block_signals(spark, html, status, wanted, auth):
    df = D.with_facts(spark.createDataFrame([("https://e.com/a", html)], "url string, html string"))
    b = df.select(D.block_signal(F.col("html"), F.col("facts"), F.lit(status), F.col("url")).alias("b")).first()["b"]
    assert (b["detected"], b["auth_required"]) == (wanted, auth)


@pytest.mark.parametrize(
    ("control", "wanted"),
    [
        ("<div class='pagination'>1</div>", True),
        ("<div class='pagination' style='display: none'>1</div>", False),
        ("<nav><a href='/q'>1</a> <a href='/r'>2</a> <a>Next</a></nav>", True),
        ("<nav><a href='/q'>1</a> <a href='/r'>About</a></nav>", False),
        ("<a href='?page=2'>Next page</a>", True),
        ("<link rel='next' href='/other'>", False),
        ("<a href='/a/page/2'>›</a>", True),
    ],
)
def test_pagination(control, wanted):
    assert D.page_facts(f"<body>{control}</body>", "https://e.com/a")["paginated"] is wanted


def test_results_keep_their_invariants(spark):
    wall = "<body><div class='paywall'>Subscribe to continue reading</div></body>"
    rows = [("https://u:p@e.com/a?q=1", ARTICLE), ("https://e.com/w", wall), ("ftp://e.com/x", "<p>x"), ("https://e.com/n", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    for budget in (None, 0, 20, 10_000):
        out = read_captures(df, budget)
        assert violations(out).count() == 0
        by = {r["url"]: r for r in out.collect()}
        assert by["https://e.com/a"]["status"] == "complete" and by["https://e.com/a"]["truncated"] is (budget in (0, 20))
        assert by["https://e.com/w"]["content"] == "" and by["https://e.com/w"]["structured_data"] is None and by["https://e.com/w"]["status"] == "unknown"
        assert by["ftp://e.com/x"]["error"]["kind"] == "policy"


def test_api_sections(spark):
    df = api.snapshots(spark.createDataFrame([("https://e.com/a", ARTICLE)], "url string, html string"))
    wanted = df.select("handle", F.explode(F.array(F.lit("second"), F.lit("none"))).alias("anchor"))
    found = {r["anchor"]: r["markdown"] for r in api.sections_of(df, wanted).collect()}
    assert found["second"].startswith("## Second") and found["none"] is None
    assert api.extract_html(spark, ARTICLE, "https://e.com/a").first()["evidence"][-1]["name"] == "supplied_html"


def test_registry():
    r = Registry()
    assert r.added(Recipe("youtube", 1, ("x",))) is r
    assert len(r.added(Recipe("own", 1, ("x",))).recipes) == len(r.recipes) + 1


def test_routes(spark):
    urls = [("https://www.reddit.com/r/a/comments/b/",), ("https://arxiv.org/abs/2101.00001",), ("https://e.com",), (None,)]
    rows = Registry().routed(spark.createDataFrame(urls, "url string")).collect()
    assert [r["recipe"] for r in rows] == ["reddit", "academic", "generic", "generic"]


def test_services(spark):
    work = '{"doi":"https://doi.org/10.1/A","title":"T","authorships":[{"author":{"display_name":"Ann Lee"}},{"author":{"display_name":"Bo Lee"}}],"biblio":{"first_page":"1","last_page":"9"},"referenced_works_count":4,"abstract_inverted_index":{"a":[0,2],"b":[1]},"locations":[{"pdf_url":"u"},{"pdf_url":null}]}'
    found = one(spark, M.openalex(F.lit(work)))
    assert (found["doi"], found["authors"], found["reference_count"], found["pdf_urls"]) == ("10.1/a", ["Lee"], 4, ["u"])
    assert one(spark, M.openalex(F.lit("not json")))["title"] is None
    reg = one(spark, M.crossref(F.lit('{"message":{"DOI":"10.1/A","title":["T"],"page":"3-7","author":[{"family":"Lee"},{"name":"Group"}],"abstract":"<p>x</p>"}}')))
    assert (reg["doi"], reg["first_page"], reg["last_page"], reg["authors"], reg["abstract"]) == ("10.1/a", "3", "7", ["Lee", "Group"], "x")
    pmc = one(spark, M.europe_pmc(F.lit('{"resultList":{"result":[{"doi":"10.2/b","pmid":"1"},{"doi":"10.1/A","pmid":"2","pageInfo":"5"}]}}'), F.lit("10.1/a")))
    assert (pmc["pmid"], pmc["last_page"]) == ("2", "5")
    assert [tuple(x) for x in one(spark, M.unpaywall(F.lit('{"best_oa_location":{"url_for_pdf":"p"},"oa_locations":[{"url_for_pdf":"p","url_for_landing_page":"l"}]}')))] == [("p", "pdf"), ("l", "landing")]
    assert one(spark, M.biorxiv(F.lit('{"collection":[{"version":"2","jatsxml":"b"},{"version":"1","jatsxml":"a"}]}'))) == "b"


@pytest.mark.parametrize(("authors", "bound", "front", "wanted"), [(["Ann Lee"], False, "Deep graph networks by Ann Lee", True), (["Bo Kim"], False, "Deep graph networks by Ann Lee", False), (["Bo Kim"], True, "other text", False), (["Bo Kim"], True, "", True), ([], False, "", False)])
def test_identity(spark, authors, bound, front, wanted):
    names = F.array(*map(F.lit, authors)) if authors else F.array().cast("array<string>")
    assert one(spark, M.identity(F.lit(front), F.lit("Deep Graph Networks"), names, F.lit(bound)))["accepted"] is wanted


def test_redirects_end(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], "from_url string, to_url string")
    rows = {r["url"]: (r["final"], r["hops"], r["looped"]) for r in A.redirect_chain(spark.createDataFrame([("a",), ("c",), ("z",)], "url string"), hops).collect()}
    assert rows == {"a": ("b", 1, True), "c": ("f", 3, False), "z": ("z", 0, False)}


def test_stream_equals_batch(spark, tmp_path):
    from sheaf.sources.captures import capture_stream
    from sheaf.streaming.captures import fresh, read_stream, write_results

    rows = spark.createDataFrame([("https://e.com/a", ARTICLE, "2024-01-01T00:00:00Z"), ("https://e.com/a", ARTICLE, "2024-01-01T00:01:00Z")], "url string, html string, fetched_at string")
    rows.write.json(str(tmp_path / "in"))
    write_results(read_stream(fresh(capture_stream(spark, str(tmp_path / "in"))), 50), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 1 and got.first()["content"] == read_captures(rows, 50).first()["content"]
