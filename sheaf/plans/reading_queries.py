"""Reads end to end: the tier ladder, filings, videos, threads at several front ends, and works, over rows of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.plans.book import Book
from sheaf.plans.filings import filing_records
from sheaf.plans.ladder import read_ladder
from sheaf.plans.page_queries import PLAIN
from sheaf.plans.routed import best_threads
from sheaf.plans.scholarly import read_works
from sheaf.plans.videos import TRACKS, video_records
from sheaf.sources.tables import table

queries = Book()
SHELL = '<html><body><script>x()</script><div id="root"></div><p>few words</p></body></html>'
CHALLENGE = "<html><head><title>Access denied</title></head><body><p>no</p></body></html>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@queries(f"""WITH p AS (SELECT page_id, (length(html) % 4)::INT AS kind, len(regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+(?:[’''-][\\p{{L}}\\p{{N}}\\p{{M}}_]+)*'))
AS words FROM pages),
a AS (SELECT *, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 1 END AS tier FROM p)
SELECT page_id, tier, CASE WHEN kind = 2 AND words < 100 THEN 4 WHEN kind = 3 THEN 2 WHEN kind = 0 AND words < 100 THEN 4 END AS next_tier, CASE WHEN kind = 3 THEN 'unknown' WHEN words >= 100 THEN 'complete' ELSE 'unknown' END AS status FROM a""")
def tier_ladder(spark, folder):
    """Each page as attempts: a script shell rendered, a challenge read signed in, a plain page, and a shell that was not rendered."""
    kind = F.length("html") % 4
    attempt = lambda tier, html: F.struct(F.lit(tier).alias("tier"), html.alias("html"))
    shell, wall = F.lit(SHELL), F.lit(CHALLENGE)
    tries = F.when(kind == 0, F.array(attempt(1, shell), attempt(2, F.col("html")))).when(
        kind == 1, F.array(attempt(1, wall), attempt(2, wall), attempt(4, F.col("html")))
    ).when(kind == 2, F.array(attempt(1, F.col("html")))).otherwise(F.array(attempt(1, shell)))
    rows = table(spark, folder, "pages").select("page_id", "url", F.explode(tries).alias("a")).select(
        "page_id", "url", "a.tier", "a.html", F.lit(200).alias("http_status")
    )
    return read_ladder(rows, key="page_id").select("page_id", "provenance.tier", "next_tier", "status")


@queries("""WITH l AS (SELECT l_orderkey, list_distinct(list((1 + l_partkey % 4)::INT)) AS items, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN len(items) = 4 THEN 'complete' ELSE 'incomplete' END WHEN o_orderstatus = 'O' THEN 'incomplete'
WHEN coalesce(len(items), 0) < 4 THEN 'incomplete' ELSE 'unknown' END AS status,
4 - coalesce(len(items), 0) AS missing FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def filing_read(spark, folder):
    """Each order as a quarterly report whose lines are items; its index tells the right size, a wrong one or none by the order's status."""
    items = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(
            F.array_sort(F.collect_set(_text("<h2>Item ", (F.col("l_partkey") % 4 + 1).cast("int"), ". Part</h2><p>text</p>"))), ""
        ).alias("body")
    )
    html = _text(
        "<html><body><main><ix:header><h2>Item 1. no</h2><h2>Item 2. no</h2><h2>Item 3. no</h2><h2>Item 4. no</h2></ix:header><p>Form 10-Q</p>",
        F.coalesce("body", F.lit("")), "</main></body></html>"
    )
    place = _text("https://www.sec.gov/Archives/edgar/data/1/", F.col("o_orderkey"), "/")
    rows = table(spark, folder, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_orderstatus", html.alias("html"), _text(place, "report.htm").alias("url"), _text(place, "index.json").alias("at")
    )
    size = F.when(F.col("o_orderstatus") == "F", F.octet_length("html")).when(F.col("o_orderstatus") == "O", 1)
    document = F.to_json(
        F.struct(F.struct(F.array(F.struct(F.lit("report.htm").alias("name"), size.cast("string").alias("size"))).alias("item")).alias("directory"))
    )
    dealt = rows.select("o_orderkey", "html", "url").repartition(spark.sparkContext.defaultParallelism)  # small rows, long to parse
    found = filing_records(dealt, rows.select(F.col("at").alias("url"), document.alias("document")))
    missing = F.size(F.from_json(F.get_json_object(F.get("structured_data.json_ld", 0), "$.missing"), "array<string>"))
    return found.select("o_orderkey", "status", missing.cast("long").alias("missing"))


@queries("""WITH t AS (SELECT conv_id, count(*) AS turns, min(turn) FILTER (role <> 'user') AS written, min(turn) AS made FROM conversations GROUP BY conv_id),
s AS (SELECT t.conv_id, array_to_string(list_filter([trim(text, ' ')], lambda x: x <> ''), ' ') AS transcript FROM t JOIN conversations c ON c.conv_id = t.conv_id
AND c.turn = coalesce(written, made))
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'incomplete' WHEN conv_id % 5 = 0 THEN 'unknown' WHEN transcript <> '' THEN 'complete' ELSE 'incomplete' END AS status,
CASE WHEN conv_id % 3 = 0 THEN '# ' || lpad(conv_id::VARCHAR, 11, '0') ELSE '# Talk ' || conv_id END || CASE WHEN conv_id % 5 <> 0
AND transcript <> '' THEN chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || transcript ELSE '' END AS content
FROM s""")
def video_read(spark, folder):
    """Each conversation as a video whose turns are its caption tracks; some without a title, some whose tracks could not be read."""
    k = F.col("conv_id")
    video = F.lpad(k.cast("string"), 11, "0")
    talk = table(spark, folder, "conversations")
    ids = talk.select("conv_id").distinct()
    info = F.when(k % 3 == 0, F.lit('{"description": " "}')).otherwise(_text('{"title": "Talk ', k, '"}'))
    rows = ids.select("conv_id", info.alias("html"), _text("https://www.youtube.com/watch?v=", video).alias("url"))
    lost = k % 5 == 0
    tracks = talk.select(
        video.alias("video"), F.col("turn").cast("int").alias("pos"), F.lit("en").alias("language"), (F.col("role") == "user").alias("is_generated"),
        F.when(~lost, F.array("text")).alias("snippets"), F.when(lost, "it could not be read").alias("error")
    )
    return video_records(rows, tracks.select(*(c.split()[0] for c in TRACKS.split(", ")))).select("conv_id", "status", "content")


@queries("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id % 4)::INT AS shown, (event_id % 3)::INT AS said,
event_id % 7 = 0 AS blocked, event_id % 11 = 0 AS deeper FROM events),
j AS (SELECT *, CASE WHEN blocked OR shown = 0 THEN NULL WHEN deeper OR shown < said THEN 'incomplete' ELSE 'complete' END AS status FROM c),
b AS (SELECT user_id, arg_max(status, (status = 'complete', CASE WHEN status = 'complete' THEN 0 WHEN deeper THEN -1 ELSE 0 END, CASE WHEN status = 'complete' THEN 0 ELSE shown
END, -i)) FILTER (status IS NOT NULL) AS status,
arg_max(shown, (status = 'complete', CASE WHEN status = 'complete' THEN 0 WHEN deeper THEN -1 ELSE 0 END, CASE WHEN status = 'complete' THEN 0 ELSE shown END,
-i)) FILTER (status IS NOT NULL) AS captured FROM j GROUP BY user_id)
SELECT user_id, coalesce(status, 'unknown') AS status, captured FROM b""")
def thread_read(spark, folder):
    """Each user's events as captures of one thread at as many front ends: blocked, empty, with unloaded replies or short of what they declare."""
    e = F.col("event_id")
    comment = '<div class="comment"><div class="comment_body"><p>text</p></div></div>'
    page = _text(
        "<html><body><main><h1>T</h1><p>", (e % 3).cast("int"), " comments</p>", F.repeat(F.lit(comment), (e % 4).cast("int")),
        F.when(e % 11 == 0, '<a class="deeper_replies">more</a>').otherwise(""), "</main></body></html>"
    )
    rows = table(spark, folder, "events").select(
        "user_id", _text("https://www.reddit.com/r/x/comments/", F.col("user_id")).alias("url"), e.alias("instance"),
        F.when(e % 7 == 0, F.lit(CHALLENGE)).otherwise(page).alias("html"), F.lit(200).alias("http_status")
    )
    found = best_threads(rows.drop("user_id"))
    captured = F.get_json_object(F.get("structured_data.json_ld", 0), "$.captured_comment_count").cast("int")
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("user_id"), "status", captured.alias("captured"))


@queries("""WITH w AS (SELECT c_custkey AS k, c_nationkey % 3 > 0 AS held, floor(abs(c_acctbal))::INT % 600 AS words, (c_custkey % 10)::INT AS found, (c_custkey % 14)::INT
AS declared, c_mktsegment = 'BUILDING' AS named FROM customer),
s AS (SELECT *, held AND named AND 2 * words >= 500 AS has, CASE WHEN declared > 0 THEN CASE WHEN found >= declared * 0.7::DOUBLE THEN true
WHEN found < declared * 0.4::DOUBLE THEN false END WHEN found >= 5 THEN true END AS refs FROM w)
SELECT k AS c_custkey, CASE WHEN NOT has THEN 'metadata_only' WHEN found > 0 THEN 'full_text_with_references' ELSE 'full_text' END AS content_level,
CASE WHEN NOT has OR refs = false THEN 'incomplete' WHEN refs THEN 'complete' ELSE 'unknown' END AS status,
CASE WHEN has THEN 'europe-pmc-jats' END AS provider, CASE WHEN has THEN '# A work of customer ' || k WHEN named THEN '# A work of customer ' || k ELSE '# Scholarly work' END AS title FROM s""")
def works_read(spark, folder):
    """Each customer as a work that two services describe, or none does, whose text an archive holds for some, with or without enough words and references."""
    k = F.col("c_custkey")
    named, held = F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 3 > 0
    doi, title = _text("10.1234/c", k), _text("A work of customer ", k)
    rows = table(spark, folder, "customer").withColumns({"doi": doi, "title": title, "words": F.floor(F.abs("c_acctbal")).cast("int") % 600})
    count = (k % 14).cast("int")
    openalex = F.to_json(F.struct("title", F.struct(_text("PMC", k).alias("pmcid")).alias("ids"), count.alias("referenced_works_count")))
    crossref = F.to_json(F.struct(F.struct(F.array("title").alias("title"), count.alias("reference-count")).alias("message")))
    service = lambda name, document: rows.where(named).select(F.col("doi").alias("key"), F.lit(name).alias("service"), document.alias("document"))
    services = service("openalex", openalex).unionByName(service("crossref", crossref))
    part = lambda name: _text(f"<sec><title>{name}</title><p>", F.repeat(F.lit("word "), F.col("words")), "</p></sec>")
    article = _text(
        "<article><front><article-title>", F.col("title"), "</article-title></front><body>", part("Introduction"), part("Methods"),
        "</body><back><ref-list>", F.repeat(F.lit("<ref>r</ref>"), (k % 10).cast("int")), "</ref-list></back></article>"
    )
    bodies = rows.where(held).select(
        _text("https://www.ebi.ac.uk/europepmc/webservices/rest/PMC", k, "/fullTextXML").alias("url"), article.cast("binary").alias("payload")
    )
    works = rows.select("c_custkey", _text("https://doi.org/", F.col("doi")).alias("url"))
    found = read_works(works, services, bodies)
    record = F.get("structured_data.json_ld", 0)
    return found.select(
        "c_custkey", "content_level", "status", F.get_json_object(record, "$.acquired.provider").alias("provider"),
        F.substring_index("content", "\n", 1).alias("title")
    )
