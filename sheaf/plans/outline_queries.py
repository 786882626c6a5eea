"""Outlines, budgets and threads over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import count_tokens, slugify
from sheaf.operators import outline as O
from sheaf.operators import threads as T
from sheaf.plans.book import Book
from sheaf.sources.tables import table

queries = Book()
BUDGET = 500


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as a section, headed by its role and number."""
    heading = F.concat_ws(" ", "role", F.col("turn").cast("string"))
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), heading.alias("heading"), F.lit(2).alias("level"),
        F.concat(F.lit("## "), heading, F.lit("\n\n"), F.col("text"), F.lit("\n\n")).alias("markdown")
    )
    return O.with_anchors(rows.withColumns({"token_count": count_tokens(F.col("markdown")), "char_count": F.length("markdown")}))


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as one Markdown text."""
    return joined_turns(table(spark, folder, "conversations"))


def joined_turns(talk: DataFrame) -> DataFrame:
    rows = talk.select(
        "conv_id", "turn",
        F.concat(F.lit("## "), F.concat_ws(" ", "role", F.col("turn").cast("string")), F.lit("\n\n"), F.col("text"), F.lit("\n\n")).alias("part")
    )
    parts = F.sort_array(F.collect_list(F.struct("turn", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("markdown"))


SECTIONS = """
t AS (SELECT conv_id AS doc, turn AS pos, role || ' ' || turn AS heading, '## ' || role || ' ' || turn || chr(10) || chr(10) || text || chr(10) || chr(10) AS markdown
FROM conversations),
k AS (SELECT *, ceil(strlen(markdown) / 4.0)::INT AS token_count, length(markdown) AS char_count,
      trim(regexp_replace(regexp_replace(lower(strip_accents(heading)), '[`*_~\\[\\]()]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t),
s AS (SELECT *, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY pos) AS n FROM k))"""
FITTED = f"""{SECTIONS},
f AS (SELECT *, sum(token_count) OVER (PARTITION BY doc ORDER BY pos) <= {BUDGET} OR ceil(sum(strlen(markdown)) OVER (PARTITION BY doc) / 4.0) <= {BUDGET} AS kept FROM s)"""


@queries(f"WITH {SECTIONS} SELECT doc, pos, heading, anchor, token_count, char_count FROM s")
def outline(spark, folder):
    return turns(spark, folder).select("doc", "pos", "heading", "anchor", "token_count", "char_count")


@queries(
    f"WITH {SECTIONS} SELECT doc, count(*) AS sections, sum(token_count)::BIGINT AS section_tokens, string_agg(anchor, '|' ORDER BY pos) AS anchors FROM s GROUP BY doc"
)
def outline_total(spark, folder):
    rows = O.outline(turns(spark, folder))
    return rows.select(
        "doc", F.size("sections").cast("long").alias("sections"), "section_tokens",
        F.array_join(F.transform("sections", lambda s: s["anchor"]), "|").alias("anchors")
    )


def fitted_turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder)
    size = F.sum(F.octet_length("markdown")).over(O.Window.partitionBy("doc"))
    return O.fitted(rows.withColumn("whole", F.ceil(size / 4)), BUDGET, F.col("whole"))


@queries(f"""WITH {FITTED} SELECT doc, coalesce(bool_or(NOT kept), false) AS truncated, count(*) FILTER (NOT kept) AS remaining_items,
    coalesce(sum(token_count) FILTER (NOT kept), 0)::BIGINT AS estimated_extra_tokens, coalesce(string_agg(anchor, '|' ORDER BY pos) FILTER (NOT kept), '') AS omitted,
    rtrim(coalesce(string_agg(markdown, '' ORDER BY pos) FILTER (kept), ''), ' ' || chr(10)) AS content FROM f GROUP BY doc""")
def budget_prefix(spark, folder):
    return O.prefix(fitted_turns(spark, folder)).select(
        "doc", "truncated", "remaining_items", "estimated_extra_tokens", F.array_join("omitted", "|").alias("omitted"), "content"
    )


@queries(f"WITH {FITTED} SELECT doc, pos, anchor, kept FROM f")
def budget_cut(spark, folder):
    return fitted_turns(spark, folder).select("doc", "pos", "anchor", "kept")


@queries(
    f"WITH {FITTED} SELECT doc, count(*) AS remaining_items, sum(token_count)::BIGINT AS estimated_extra_tokens, 0::BIGINT AS unknown FROM f WHERE NOT kept GROUP BY doc"
)
def omitted_cost(spark, folder):
    cut = fitted_turns(spark, folder)
    found = O.cost_of(cut.where("not kept").select("doc", "anchor"), cut)
    return found.select("doc", "remaining_items", "estimated_extra_tokens", F.size("unknown").cast("long").alias("unknown"))


@queries(f"""WITH {SECTIONS}, w AS (SELECT doc, anchor FROM s UNION SELECT doc, 'no-such-anchor' FROM s)
SELECT doc, anchor, rtrim(markdown, ' ' || chr(10)) AS markdown FROM w LEFT JOIN s USING (doc, anchor)""")
def section_lookup(spark, folder):
    rows = turns(spark, folder)
    wanted = rows.select("doc", F.explode(F.array(F.col("anchor"), F.lit("no-such-anchor"))).alias("anchor")).distinct()
    return O.section_by_anchor(rows, wanted)


@queries("""WITH RECURSIVE t AS (SELECT conv_id AS doc, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || CASE WHEN contains(text,
'e') THEN '```' || chr(10) || '# ' || text || chr(10) || '~~~' || chr(10) || CASE WHEN length(text) % 2 = 0 THEN '```' ELSE '' END ELSE text END || chr(10) || chr(10), ''
ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id),
x AS (SELECT doc, string_split(markdown, chr(10)) AS lines FROM t),
m AS (SELECT doc, i, lines[i] AS line, substr(regexp_extract(lines[i], '^\\s*(```|~~~)', 1), 1, 1) AS mark FROM x, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
f AS (SELECT doc, i, line, mark, row_number() OVER (PARTITION BY doc ORDER BY i) AS k FROM m WHERE mark <> ''),
w AS (SELECT doc, 0::BIGINT AS k, '' AS fence FROM t UNION ALL SELECT w.doc, f.k, CASE WHEN w.fence = '' THEN f.mark WHEN w.fence = f.mark THEN '' ELSE w.fence END FROM w
JOIN f ON f.doc = w.doc AND f.k = w.k + 1),
h AS (SELECT m.doc, m.i, m.line, coalesce(max(f.k), 0) AS k FROM m LEFT JOIN f ON f.doc = m.doc AND f.i < m.i WHERE m.mark = '' AND regexp_matches(m.line, '^\\s{0,3}#{1,6}\\s+.+$')
GROUP BY ALL)
SELECT h.doc, count(*) AS headings, string_agg(length(regexp_extract(line, '^\\s*(#+)', 1)), ',' ORDER BY i) AS levels FROM h JOIN w ON w.doc = h.doc AND w.k = h.k WHERE w.fence = '' GROUP BY h.doc""")
def markdown_sections(spark, folder):
    fenced = F.concat(F.lit("```\n# "), F.col("text"), F.lit("\n~~~\n"), F.when(F.length("text") % 2 == 0, "```").otherwise(""))
    talk = table(spark, folder, "conversations").withColumn("text", F.when(F.col("text").contains("e"), fenced).otherwise(F.col("text")))
    rows = O.sections(joined_turns(talk), "conv_id").where("level > 0")
    levels = F.transform(F.sort_array(F.collect_list(F.struct("pos", "level"))), lambda s: s["level"].cast("string"))
    return rows.groupBy("doc").agg(F.count("*").alias("headings"), F.array_join(levels, ",").alias("levels"))


@queries("""SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id))::INT AS rank FROM events""")
def thread_rank(spark, folder):
    return T.ranked(table(spark, folder, "events"), "user_id", "value", "event_id").select("event_id", "user_id", "rank")


@queries("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank, ceil(strlen(props) / 4.0)::INT AS token_count
FROM events),
k AS (SELECT *, rank <= 20 AND 10 + sum(token_count) OVER (PARTITION BY user_id ORDER BY rank) <= 60 AS kept FROM r)
SELECT user_id, count(*) FILTER (kept) AS kept_items, count(*) FILTER (NOT kept) AS remaining_items, coalesce(sum(token_count) FILTER (NOT kept), 0)::BIGINT AS estimated_extra_tokens FROM k GROUP BY user_id""")
def thread_core(spark, folder):
    rows = T.ranked(table(spark, folder, "events"), "user_id", "value", "event_id").withColumn("token_count", count_tokens(F.col("props")))
    kept = T.core(rows, 60, 20, 10, "user_id")
    return T.completion_cost(kept, "user_id").join(kept.groupBy("user_id").agg(F.count_if("kept").alias("kept_items")), "user_id")


@queries("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
SELECT conv_id AS thread, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY rank) AS markdown FROM r GROUP BY conv_id""")
def thread_markdown(spark, folder):
    talk = table(spark, folder, "conversations")
    rows = T.ranked(
        talk.select(
            F.col("conv_id").alias("thread"), F.lit(None).cast("int").alias("score"), "turn", F.col("role").alias("author"),
            F.col("text").alias("body")
        ),
        pos="turn"
    )
    heads = talk.select(F.col("conv_id").alias("thread"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title")).distinct()
    return T.thread_markdown(heads, rows)


@queries("""WITH a AS (SELECT conv_id, turn AS attempt, CASE WHEN turn % 3 = 0 THEN 'unknown' WHEN turn % 3 = 1 THEN 'incomplete' ELSE 'complete' END AS status, turn % 2 AS deeper,
length(text) AS captured FROM conversations)
SELECT conv_id, first(attempt ORDER BY CASE status WHEN 'complete' THEN 2 WHEN 'incomplete' THEN 1 ELSE 0 END DESC, deeper, captured DESC, attempt) AS best FROM a GROUP BY conv_id""")
def best_candidate(spark, folder):
    t = F.col("turn")
    rows = table(spark, folder, "conversations").select(
        "conv_id", t.alias("attempt"), F.when(t % 3 == 0, "unknown").when(t % 3 == 1, "incomplete").otherwise("complete").alias("status"),
        (t % 2).alias("deeper"), F.length("text").alias("captured")
    )
    return T.best_candidate(rows, "conv_id", F.col("attempt"))


@queries(
    """SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[`*_~\\[\\]()]', '', 'g'),
'[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS slug FROM conversations"""
)
def heading_slug(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", slugify(F.col("text")).alias("slug"))
