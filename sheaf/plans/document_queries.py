"""Papers, threads, listings and videos, each made from a row of the tables and read again by the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.operators import discussions as T
from sheaf.operators import media as M
from sheaf.operators import papers as P
from sheaf.plans.book import Book
from sheaf.sources.tables import table

queries = Book()


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@queries("""SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || '### Part ' || c_nationkey || chr(10) || chr(10) || 'Text.'
|| CASE WHEN c_custkey % 3 > 0 THEN chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '1. One' || CASE WHEN c_custkey % 3 = 2 THEN chr(10) || '2. Two' ELSE '' END
ELSE '' END AS markdown,
(c_custkey % 3)::INT AS reference_count, c_custkey % 3 > 0 AS references_resolved FROM customer""")
def jats_markdown(spark, folder):
    k = F.col("c_custkey")
    refs = F.when(
        k % 3 > 0, _text("<back><ref-list><ref>One</ref>", F.when(k % 3 == 2, "<ref> Two </ref>").otherwise(""), "</ref-list></back>")
    ).otherwise("")
    xml = _text(
        '<article xmlns="urn:x"><front><article-title>', F.col("c_name"), "</article-title><abstract><p>", F.col("c_mktsegment"),
        "</p></abstract></front><body><sec><title>Methods</title><sec><title>Part ", F.col("c_nationkey"), "</title><p>Text.</p></sec></sec></body>",
        refs, "</article>"
    )
    return P.with_jats(table(spark, folder, "customer").select("c_custkey", xml.alias("payload"))).select(
        "c_custkey", "paper.markdown", "paper.reference_count", "paper.references_resolved"
    )


@queries("SELECT doc_id, (doc_id % 50 + 1)::INT AS refs FROM documents")
def bibliography_count(spark, folder):
    made = _text(
        "# Paper\n[77] cited\n", F.coalesce("text", F.lit("")), "\n\n## References\n1. a\n[", F.col("doc_id") % 50 + 1, "] b\n# After\n99. z"
    )
    return table(spark, folder, "documents").select("doc_id", P.bibliography_count(made).alias("refs"))


@queries("SELECT page_id, page_id % 6 IN (0, 1, 2) AS article FROM pages")
def article_url(spark, folder):
    key = F.col("page_id") % 6
    url = F.when(key == 0, _text("https://www.nature.com/articles/s", F.col("page_id"))).when(key == 1, _text("https://gut.bmj.com/content/", F.col("page_id"), "?x=1")).when(key == 2, _text("http://dx.doi.org/10.1234/a", F.col("page_id"))).when(key == 3, _text("https://www.nature.com/news/", F.col("page_id"))).when(
        key == 4, _text("https://blast.ncbi.nlm.nih.gov/pmc/articles/PMC", F.col("page_id"))
    ).otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", P.is_article_url(url).alias("article"))


@queries("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://journal.example/' || c_custkey WHEN 1 THEN 'https://doi.org/10.1234/a' || c_custkey
WHEN 2 THEN 'https://open.example/' || c_custkey END AS page,
'# ' || c_name || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '## Abstract' || chr(10) || chr(10) || c_mktsegment ELSE 'PMID: ' || c_custkey END AS content, CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 450 * (1 + c_custkey % 3) END::BIGINT AS cost FROM customer""")
def partial_result(spark, folder):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    places = F.array(
        F.struct(_text("https://europepmc.org/", k).alias("url"), F.lit("landing").alias("kind")),
        F.struct(_text("https://open.example/", k).alias("url"), F.when(k % 4 == 2, "landing").otherwise("pdf").alias("kind"))
    )
    page = P.publisher_page(
        F.when(k % 4 == 0, _text("https://journal.example/", k)).otherwise(_text("https://doi.org/", k)), F.when(k % 4 == 1, _text("10.1234/a", k)),
        places, none
    )
    abstract = F.when(k % 2 == 0, F.col("c_mktsegment"))
    cost = P.full_text_cost(F.when(k % 2 == 1, "10"), F.when(k % 2 == 1, (F.lit(10) + k % 3).cast("string")), abstract)
    return table(spark, folder, "customer").select(
        "c_custkey", page.alias("page"), P.partial_markdown(F.col("c_name"), abstract, {"DOI": none, "PMID": k.cast("string")}).alias("content"),
        cost.alias("cost")
    )


@queries("""WITH c AS (SELECT c_custkey, c_name, c_custkey % 7 AS a, c_custkey % 5 AS b, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 4 END AS reported FROM customer),
t AS (SELECT *, '## Comment a' || chr(10) || chr(10) || 'Score: ' || a || ' | Author: ' || c_name || chr(10) || chr(10) || '> first' AS ta,
'## Comment b' || chr(10) || chr(10) || 'Score: ' || b || chr(10) || chr(10) || '> second' AS tb FROM c)
SELECT c_custkey, '# Thread' || chr(10) || chr(10) || 'Subreddit: r/spark' || chr(10) || chr(10) || 'Reported comments: ' || reported || chr(10) || chr(10) || 'Unloaded reply subtrees: 0' || chr(10) || chr(10)
|| CASE WHEN a >= b THEN ta || chr(10) || chr(10) || tb ELSE tb || chr(10) || chr(10) || ta END AS content, CASE WHEN reported = 3 THEN 'complete' ELSE 'incomplete' END AS status,
'comment-c-1' AS omitted, 1 AS remaining_items,
CEIL(octet_length(encode('## Comment C 1' || chr(10) || chr(10) || 'Score: unknown' || chr(10) || chr(10) || '> third')) / 4.0)::BIGINT AS estimated_extra_tokens FROM t""")
def thread_page(spark, folder):
    """A page of three comments each, the first two kept."""
    k = F.col("c_custkey")
    block = lambda name, score, body, more="": _text(
        '<div class="comment" id="', name, '">', more, '<p class="comment_score">', score, '</p><div class="comment_body"><p>', body,
        "</p></div></div>"
    )
    html = _text(
        "<html><body><main><h1>Thread - Redlib</h1><p>", F.when(k % 2 == 0, "3").otherwise("4"), " comments</p>", block("C 1", "Vote", "third"),
        block("a", k % 7, "first", _text('<a class="comment_author">', F.col("c_name"), "</a>")), block("b", k % 5, "second"), "</main></body></html>"
    )
    rows = table(spark, folder, "customer").select(
        "c_custkey", html.alias("html"), _text("https://old.reddit.com/r/spark/comments/x", k).alias("url")
    )
    return T.thread_results(rows, limit=2).select(
        "c_custkey", "content", "status", F.array_join("omitted", ",").alias("omitted"), "cost_to_complete.remaining_items",
        "cost_to_complete.estimated_extra_tokens"
    )


@queries("""SELECT c_custkey, '# Lot ' || c_name || chr(10) || chr(10) || '- **Price:** ' || CASE WHEN c_custkey % 2 = 0 THEN '$' || c_custkey ELSE c_custkey || ' USD'
END || chr(10) || '- **Condition:** Used - Good' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '- **Status:** Sold' ELSE '' END
|| CASE WHEN c_custkey % 5 > 0 THEN chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || c_mktsegment ELSE '' END AS content, CASE WHEN c_custkey % 5 > 0 THEN 'complete' ELSE 'incomplete' END AS status FROM customer""")
def listing_page(spark, folder):
    """A page of an item's two objects and another item's."""
    k = F.col("c_custkey")
    item = k.cast("string").alias("id")
    other = F.to_json(
        F.struct(
            _text("9", k).alias("id"), F.lit("Other").alias("marketplace_listing_title"), F.struct(F.lit("Far").alias("text")).alias("location_text")
        )
    )
    first = F.to_json(
        F.struct(
            item, _text("Lot ", F.col("c_name")).alias("marketplace_listing_title"),
            F.struct(k.cast("string").alias("amount"), F.lit("USD").alias("currency")).alias("listing_price"),
            F.lit("PC_USED_GOOD").alias("condition")
        )
    )
    second = F.to_json(
        F.struct(
            item, F.lit("Late").alias("marketplace_listing_title"),
            F.when(k % 2 == 0, F.struct(_text("$", k).alias("text"))).alias("formatted_price"),
            F.when(k % 5 > 0, F.struct(F.col("c_mktsegment").alias("text"))).alias("redacted_description"), (k % 3 == 0).alias("is_sold")
        )
    )
    html = _text('<html><script type="application/json">[', other, ",", first, ',{"deep":[', second, "]}]</script></html>")
    rows = table(spark, folder, "customer").select(
        "c_custkey", html.alias("html"), _text("https://www.facebook.com/marketplace/item/", k, "/").alias("url")
    )
    return M.listing_results(rows).select("c_custkey", "content", "status")


@queries(
    """SELECT c_custkey, '# ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '## Chapters' || chr(10) || chr(10) || '- ' || c_custkey || 's: Untitled' ELSE ''
END || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'made' ELSE 'written' END AS content FROM customer"""
)
def video_record(spark, folder):
    k = F.col("c_custkey")
    track = lambda text, made: F.struct(F.lit(text).alias("text"), made.alias("is_generated"))
    best = M.chosen_track(F.array(track("made", F.lit(True)), track("written", k % 3 == 0)))
    chapters = F.when(k % 2 == 0, F.array(F.struct(k.alias("start_time"), F.lit(None).cast("string").alias("title"))))
    return table(spark, folder, "customer").select(
        "c_custkey", M.video_markdown(F.col("c_name"), k.cast("string"), F.lit(" "), chapters, best["text"]).alias("content")
    )
