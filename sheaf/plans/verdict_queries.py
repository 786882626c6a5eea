"""Verdicts from facts derived of documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import verdict as V
from sheaf.plans.book import Book
from sheaf.sources.tables import table

queries = Book()


def facts(spark: SparkSession, folder: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, folder, "documents").select(
        "doc_id", (d % 11).alias("total"), F.least(d % 11, d % 13).alias("represented"), (n % 400).alias("dom"), (n * 7 % 400).alias("output"), F.when(
            d % 3 > 0, n % 300
        ).alias("declared"), (d % 17 == 0).alias("blocked"), (d % 5 == 0).alias("paginated"), (d % 10 == 0).alias("covered")
    )


FACTS = """f AS (SELECT doc_id, doc_id % 11 AS total, least(doc_id % 11, doc_id % 13) AS represented, n_chars % 400 AS dom, n_chars * 7 % 400 AS output, CASE
WHEN doc_id % 3 > 0 THEN n_chars % 300 END AS declared,
doc_id % 17 = 0 AS blocked, doc_id % 5 = 0 AS paginated, doc_id % 10 = 0 AS covered FROM documents),
s AS (SELECT doc_id, blocked, CASE WHEN total > 0 THEN CASE WHEN represented / total >= 0.9 THEN true WHEN represented / total <= 0.6 THEN false END END AS heading,
CASE WHEN dom >= 100 THEN CASE WHEN output >= ceil(dom * 0.8::DOUBLE) THEN true WHEN output <= floor(dom * 0.6::DOUBLE) THEN false END END AS coverage,
CASE WHEN declared IS NOT NULL THEN CASE WHEN output >= ceil(declared * 0.85::DOUBLE) THEN true WHEN output <= floor(declared * 0.7::DOUBLE) THEN false END END AS length,
CASE WHEN paginated THEN covered END AS pagination FROM f),
v AS (SELECT *, CASE WHEN blocked THEN 'unknown' WHEN pagination = false THEN 'incomplete' WHEN heading = false OR coverage = false OR length = false THEN 'incomplete'
WHEN coalesce(heading, false)::INT + coalesce(coverage, false)::INT + coalesce(length, false)::INT >= 2 THEN 'complete' ELSE 'unknown' END AS status FROM s)"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    rows = facts(spark, folder).select(
        "doc_id", "blocked", V.heading_signal(c("total"), c("represented")).alias("heading"),
        V.coverage_signal(c("dom"), c("output")).alias("coverage"), V.length_signal(c("declared"), c("output")).alias("length"),
        V.pagination_signal(c("paginated"), c("covered")).alias("pagination")
    )
    return rows.withColumn("status", V.generic_status(c("heading"), c("coverage"), c("length"), c("blocked"), c("pagination")))


@queries(f"WITH {FACTS} SELECT doc_id, heading, coverage, length, pagination, status FROM v")
def verdict_from_facts(spark, folder):
    return judged(spark, folder).drop("blocked")


@queries(f"""WITH {FACTS} SELECT doc_id, coalesce(heading = false OR coverage = false OR length = false, false) OR coalesce(heading = false, false) OR coalesce(coverage = false,
false) OR coalesce(length = false, false) AS failed,
coalesce(heading AND coverage AND length, false) AS passed,
CASE WHEN coalesce(heading = false, false) OR coalesce(coverage = false, false) OR coalesce(length = false, false) THEN 'incomplete' WHEN coalesce(heading AND coverage AND length,
false) THEN 'complete' ELSE 'unknown' END AS strict,
CASE WHEN doc_id % 2 = 0 AND NOT blocked THEN 'incomplete' ELSE status END AS after_truncation FROM v""")
def evidence_fold(spark, folder):
    rows = judged(spark, folder).withColumn("e", V.evidence(heading=F.col("heading"), coverage=F.col("coverage"), length=F.col("length")))
    return rows.select(
        "doc_id", V.any_failed(F.col("e")).alias("failed"), V.all_passed(F.col("e")).alias("passed"), V.strict_status(F.col("e")).alias("strict"),
        V.truncated_capture(F.col("status"), F.col("doc_id") % 2 == 0, F.col("blocked")).alias("after_truncation")
    )


@queries("""WITH f AS (SELECT doc_id, doc_id % 4 > 0 AS has_paper, doc_id % 3 = 0 AS is_pdf, (doc_id % 5)::INT AS sections, n_chars AS body, CASE
WHEN doc_id % 7 > 0 THEN n_chars % 600 END AS abstract,
CASE WHEN doc_id % 6 > 0 THEN 1 + doc_id % 12 END AS pages, doc_id % 30 AS refs, doc_id % 8 > 0 AS resolved, doc_id % 41 AS crossref, CASE WHEN doc_id % 9 > 0 THEN doc_id % 37 END
AS openalex FROM documents),
s AS (SELECT *, coalesce(has_paper AND sections >= 2 AND body >= 500 AND (abstract IS NULL OR abstract = 0 OR (body >= abstract + 300 AND body >= abstract * 2.5)), false)
AS section,
CASE WHEN has_paper AND abstract > 0 AND (body <= abstract + 100 OR body <= abstract * 1.5) THEN false END AS contained,
CASE WHEN has_paper AND pages > 0 THEN CASE WHEN body / (pages * 450) >= 0.5 THEN true WHEN body / (pages * 450) < 0.2 THEN false END END AS extent,
CASE WHEN crossref > 0 AND openalex > 0 THEN CASE WHEN CASE WHEN has_paper THEN refs ELSE 0 END >= least(crossref, openalex) * 0.7::DOUBLE THEN true WHEN CASE
WHEN has_paper THEN refs ELSE 0 END < least(crossref, openalex) * 0.4::DOUBLE THEN false END ELSE CASE WHEN has_paper AND refs >= 5 THEN true END END AS manifest FROM f),
b AS (SELECT *, has_paper AND contained IS NULL AND (section OR (is_pdf AND coalesce(extent, false))) AS has_body FROM s)
SELECT doc_id, CASE WHEN NOT has_body THEN CASE WHEN abstract > 0 THEN 'abstract_only' ELSE 'metadata_only' END WHEN resolved AND refs > 0 THEN 'full_text_with_references'
ELSE 'full_text' END AS content_level,
CASE WHEN NOT has_body THEN 'incomplete' WHEN contained IS NOT NULL OR coalesce(extent = false, false) OR (is_pdf AND coalesce(manifest = false, false) AND refs = 0) OR (NOT is_pdf
AND (coalesce(manifest = false, false) OR NOT section)) THEN 'incomplete'
WHEN extent IS NULL AND pages > 0 THEN 'unknown' WHEN section AND coalesce(manifest, false) THEN 'complete' ELSE 'unknown' END AS status FROM b""")
def scholarly_from_facts(spark, folder):
    d, n = F.col("doc_id"), F.col("n_chars")
    f = {
        "has_paper": d % 4 > 0, "is_pdf": d % 3 == 0, "sections": d % 5, "body_words": n, "abstract_words": F.when(d % 7 > 0, n % 600),
        "pages": F.when(d % 6 > 0, 1 + d % 12), "references": d % 30, "resolved": d % 8 > 0, "crossref": d % 41, "openalex": F.when(d % 9 > 0, d % 37)
    }
    rows = table(spark, folder, "documents").select("doc_id", *(c.alias(k) for k, c in f.items()))
    own = {k: F.col(k) for k in f}
    return rows.select("doc_id", V.scholarly_verdict(own, V.scholarly_signals(own)).alias("v")).select("doc_id", "v.content_level", "v.status")


@queries("""WITH r AS (SELECT l_orderkey, l_linenumber, (['Abstract','1 Introduction','Methods','2.1 Results','Author contributions','Discussion','C reactive protein','Comments','References','Appendix B','Supplementary notes'])[1 + (l_partkey % 11)::INT] AS title, l_quantity::INT AS words FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, title, words) AS i FROM r),
p AS (SELECT *, trim(regexp_replace(lower(title), '^\\d+(\\.\\d+)*\\s*', '')) AS plain FROM l),
b AS (SELECT l_orderkey, min(i) FILTER (plain IN ('references', 'appendix b')) AS back FROM p GROUP BY l_orderkey),
m AS (SELECT p.* FROM p JOIN b USING (l_orderkey) WHERE (back IS NULL OR i < back) AND plain NOT IN ('abstract', 'comments', 'author contributions') AND words > 0)
SELECT l_orderkey, coalesce(string_agg(title, ',' ORDER BY i), '') AS sections, coalesce(sum(words), 0)::BIGINT AS words FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN m USING (l_orderkey) GROUP BY l_orderkey""")
def body_profile(spark, folder):
    """Each order as a paper's Markdown: a line is a section of as many words as its quantity."""
    titles = (
        "Abstract", "1 Introduction", "Methods", "2.1 Results", "Author contributions", "Discussion", "C reactive protein", "Comments", "References",
        "Appendix B", "Supplementary notes"
    )
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("l_partkey") % 11 + 1).cast("int"))
    words = F.col("l_quantity").cast("int")
    part = F.concat(F.lit("\n\n## "), title, F.lit("\n\n"), F.repeat(F.lit("word "), words))
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", title.alias("title"), words.alias("words"), part.alias("part"))))
    papers = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.concat(F.lit("# Paper"), F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("markdown")
    )
    rows = papers.select("l_orderkey", V.body_profile(V.paper_sections(F.col("markdown"))).alias("p"))
    return rows.select("l_orderkey", F.array_join("p.sections", ",").alias("sections"), "p.words")


@queries("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 50),
m AS (SELECT e.user_id, e.event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS n FROM events e LEFT JOIN k ON k.user_id = e.user_id
AND k.event_type = e.event_type WHERE k.user_id IS NULL),
a AS (SELECT user_id, count(*) AS missing, string_agg(event_type, ', ' ORDER BY n) FILTER (n <= 3) AS shown FROM m GROUP BY user_id)
SELECT user_id, coalesce(missing, 0)::INT AS missing, coalesce(shown, '') || CASE WHEN missing > 3 THEN ' (+' || (missing - 3) || ' more)' ELSE '' END AS examples FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id)""")
def missing_headings(spark, folder):
    """Each user's events as a page's headings, and the types of those of a high value as the headings that were kept."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    rows = table(spark, folder, "events").groupBy("user_id").agg(
        own.alias("dom"), F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("known")
    )
    found = rows.select("user_id", V.missing_headings(F.col("dom"), F.col("known"), F.array().cast("array<string>")).alias("m"))
    return found.select("user_id", F.size("m").alias("missing"), V.examples(F.col("m")).alias("examples"))
