"""Attempts, manifests and routing over events, orders, customers and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import attempts as A
from sheaf.operators import manifests as M
from sheaf.operators.threads import capture_status
from sheaf.plans.book import Book
from sheaf.sources.tables import table

queries = Book()


@queries(
    "SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id, first(value ORDER BY ts, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id"
)
def first_success(spark, folder):
    return A.first_success(table(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", ["event_id", "value"])


@queries("""SELECT event_id, (400 + event_id % 110) IN (429, 500, 502, 503, 504) AS transient,
CASE WHEN (400 + event_id % 110) IN (429, 500, 502, 503, 504) AND 1 + user_id % 4 < 4 THEN (2 ** (user_id % 4))::INT END AS delay FROM events""")
def retry_class(spark, folder):
    status, attempt = 400 + F.col("event_id") % 110, 1 + F.col("user_id") % 4
    return table(spark, folder, "events").select("event_id", A.is_transient(status).alias("transient"), A.retry_delay(status, attempt).alias("delay"))


FACTS = """f AS (SELECT event_id, event_id % 7 = 0 AS auth, event_id % 5 = 0 AS blocked, event_id % 3 = 0 AS paginated, event_id % 2 = 0 AS shell,
CASE event_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'unknown' END AS status FROM events),
g AS (SELECT *, CASE WHEN auth THEN 'auth' WHEN blocked THEN 'block' WHEN paginated THEN 'pagination' WHEN status = 'complete' THEN NULL ELSE 'verification' END AS failure FROM f)"""


@queries(f"""WITH {FACTS} SELECT event_id, failure,
coalesce(CASE WHEN failure IN ('auth', 'pagination') THEN false WHEN failure = 'block' THEN true ELSE shell AND failure = 'verification' AND status = 'unknown' END, false)
AS render,
coalesce(status <> 'complete' AND failure IN ('auth', 'block', 'verification'), false) AS authenticate FROM g""")
def escalation(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id", (e % 7 == 0).alias("auth"), (e % 5 == 0).alias("blocked"), (e % 3 == 0).alias("paginated"), (e % 2 == 0).alias("shell"),
        F.when(e % 4 == 0, "complete").when(e % 4 == 1, "incomplete").otherwise("unknown").alias("status")
    )
    rows = rows.withColumn("failure", A.failure(F.col("auth"), F.col("blocked"), F.col("paginated"), F.col("status")))
    return rows.select(
        "event_id", "failure", A.should_render(F.col("failure"), F.col("status"), F.col("shell")).alias("render"),
        A.should_authenticate(F.lit(1), F.lit(None), F.col("status"), F.col("failure")).alias("authenticate")
    )


@queries("""WITH a AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' END AS error, CASE WHEN event_id % 4 = 0 THEN 'complete' ELSE 'unknown' END AS status, event_id % 5 = 0
AS policy, event_id % 3 > 0 AS fetched, event_id % 7 = 0 AS blocked, event_id % 13 = 0 AS blank FROM events)
SELECT event_id, CASE WHEN error IS NOT NULL THEN 'anonymous' WHEN status = 'complete' THEN 'auth' WHEN policy OR NOT fetched OR blocked OR blank THEN 'anonymous' ELSE 'auth' END
AS chosen,
error IS NULL AND fetched AND NOT blank AND NOT (event_id % 2 = 0 AND blocked AND NOT policy) AS improved FROM a""")
def attempt_choice(spark, folder):
    e = F.col("event_id")
    fields = F.struct(
        F.when(e % 11 == 0, "x").alias("error"), F.when(e % 4 == 0, "complete").otherwise("unknown").alias("status"), (e % 5 == 0).alias("policy"),
        (e % 3 > 0).alias("fetched"), (e % 7 == 0).alias("blocked"), (e % 13 == 0).alias("blank"), (e % 13 > 0).alias("extracted"),
        F.when(e % 7 == 0, "block").otherwise("none").alias("failure")
    )
    old = F.struct(F.when(e % 2 == 0, "block").otherwise("none").alias("failure"))
    return table(spark, folder, "events").select(
        "event_id", A.choose_authenticated(fields).alias("chosen"), A.render_improved(old, fields).alias("improved")
    )


@queries("""WITH c AS (SELECT l_orderkey, count(*) AS captured, max(l_linenumber) AS reported, count(*) FILTER (l_returnflag = 'R') AS deeper FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(captured, 0) AS captured, CASE WHEN coalesce(captured, 0) = 0 THEN 'unknown' WHEN deeper > 2 THEN 'incomplete'
WHEN captured < reported + (o_orderkey % 2) THEN 'incomplete' ELSE 'complete' END AS status
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def manifest_reconcile(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("captured"), F.max("l_linenumber").alias("reported"), F.count_if(F.col("l_returnflag") == "R").alias("deeper")
    )
    rows = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    captured = F.coalesce("captured", F.lit(0))
    return rows.select(
        "o_orderkey", captured.alias("captured"),
        capture_status(captured, F.col("reported") + F.col("o_orderkey") % 2, F.greatest(F.col("deeper") - 2, F.lit(0))).alias("status")
    )


@queries("""WITH e AS (SELECT DISTINCT event_type FROM events), f AS (SELECT DISTINCT user_id, event_type FROM events), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(string_agg(e.event_type, ',' ORDER BY e.event_type) FILTER (f.event_type IS NULL), '') AS missing, count(f.event_type) AS found FROM u CROSS JOIN e LEFT JOIN f USING (user_id, event_type) GROUP BY user_id""")
def item_manifest(spark, folder):
    events = table(spark, folder, "events")
    expected = events.agg(F.sort_array(F.collect_set("event_type")).alias("expected"))
    found = events.groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    rows = found.crossJoin(F.broadcast(expected))  # one row of a few types, an aggregate without groups
    return rows.select(
        "user_id", F.array_join(M.missing_items(F.col("expected"), F.col("found")), ",").alias("missing"), F.size("found").cast("long").alias("found")
    )


@queries("""WITH c AS (SELECT c_nationkey AS nation, min(c_name) AS name, max(c_acctbal) AS balance FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS nation, min(s_name) AS name, max(s_acctbal) AS balance FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, coalesce(c.name, s.name) AS name, coalesce(CASE WHEN c.balance > 9000 THEN NULL ELSE c.balance END, s.balance) AS balance,
array_to_string(list_distinct(list_filter([c.name, s.name], lambda x: x IS NOT NULL)).list_sort(), ',') AS sources FROM c FULL JOIN s ON c.nation = s.nation""")
def metadata_merge(spark, folder):
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.min("c_name").alias("name"), F.max("c_acctbal").alias("balance")
    )
    c = c.withColumn("balance", F.when(F.col("balance") <= 9000, F.col("balance"))).withColumn("seq", F.lit(1))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.min("s_name").alias("name"), F.max("s_acctbal").alias("balance")
    ).withColumn("seq", F.lit(2))
    both = c.unionByName(s).withColumn("names", F.array("name"))
    return M.merged(both, "nation", "seq", ["name", "balance"], ["names"]).select(
        "nation", "name", "balance", F.array_join(F.sort_array("names"), ",").alias("sources")
    )


@queries(
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1"
)
def location_dedupe(spark, folder):
    return M.deduplicated(table(spark, folder, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@queries("""SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS types
FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id""")
def ordered_distinct(spark, folder):
    seen = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    rows = table(spark, folder, "events").groupBy("user_id").agg(seen.alias("seen"))
    return rows.select("user_id", F.array_join(X.ordered_distinct(F.col("seen")), ",").alias("types"))


@queries(
    "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0"
)
def inverted_text(spark, folder):
    """Each text as the index of its words, and read back from that. Texts are dealt by document once, so no step after it moves a word."""
    docs = table(spark, folder, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("at", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("at").alias("positions")).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index")
    )
    return M.inverted_text(index, "doc_id", "index")


@queries(
    """SELECT page_id, CASE WHEN regexp_matches(url, '/en/\\d*1(\\D|$)') THEN 'ones' WHEN contains(url, 'blog.') THEN 'blog' WHEN regexp_matches(url,
'\\.(net|org)/') THEN 'network' ELSE 'generic' END AS recipe FROM pages"""
)
def url_route(spark, folder):
    recipes = [("network", 90, (r"\.net/", r"\.ORG/")), ("blog", 120, (r"blog\.",)), ("ones", 130, (r"/en/\d*1(\D|$)",))]
    return A.route(table(spark, folder, "pages"), recipes).select("page_id", "recipe")


@queries("SELECT p_brand AS name, first(p_partkey ORDER BY p_size DESC, p_partkey DESC) AS seq, max(p_size) AS priority FROM part GROUP BY p_brand")
def recipe_replace(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq"))
    return A.replaced(rows)


@queries("""WITH h AS (SELECT 'u' || n_nationkey AS from_url, 'u' || ((n_nationkey * 2) % 25) AS to_url FROM nation WHERE n_nationkey % 5 <> 1),
x AS (SELECT 1) SELECT url, final, hops, looped FROM (
WITH RECURSIVE c AS (SELECT 'u' || n_nationkey AS url, 'u' || n_nationkey AS final, 0 AS hops, ['u' || n_nationkey] AS seen, false AS looped, 0 AS step FROM nation
UNION ALL SELECT url, CASE WHEN to_url IS NOT NULL AND NOT list_contains(seen, to_url) THEN to_url ELSE final END, hops + CASE WHEN to_url IS NOT NULL AND NOT list_contains(seen,
to_url) THEN 1 ELSE 0 END,
CASE WHEN to_url IS NOT NULL AND NOT list_contains(seen, to_url) THEN list_append(seen, to_url) ELSE seen END, looped OR coalesce(list_contains(seen, to_url), false), step + 1
FROM c LEFT JOIN h ON final = from_url AND NOT looped WHERE step < 3) SELECT * FROM c WHERE step = 3)""")
def redirect_chain(spark, folder):
    k = F.col("n_nationkey")
    nation = table(spark, folder, "nation")
    hops = nation.where(k % 5 != 1).select(
        F.concat(F.lit("u"), k.cast("string")).alias("from_url"), F.concat(F.lit("u"), (k * 2 % 25).cast("string")).alias("to_url")
    )
    return A.redirect_chain(nation.select(F.concat(F.lit("u"), k.cast("string")).alias("url")), hops)


@queries("""WITH b AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: length(t) > 2
AND t NOT IN ('a','an','and','as','at','by','for','from','in','is','of','on','or','the','to','using','via','with')) AS wanted, text FROM benchmark),
o AS (SELECT item_id, wanted, list_filter(wanted, lambda t: list_contains(list_distinct(regexp_extract_all(lower(substr('Li Zyx ' || array_to_string(list_filter(string_split(text,
' '), lambda w: length(w) % 2 = 0), ' '), 1, 8000)), '[a-z0-9]+')), t)) AS shared FROM b)
SELECT item_id, CASE WHEN len(wanted) > 0 THEN len(shared) / len(wanted) ELSE 0.0 END AS overlap, len(wanted) > 0 AND len(shared) / len(wanted) >= 0.6 AS accepted FROM o""")
def title_identity(spark, folder):
    """Each item's text as a title, against a text of its words of even length by an author of a short name."""
    front = F.concat(F.lit("Li Zyx "), F.array_join(F.filter(F.split("text", " "), lambda w: F.length(w) % 2 == 0), " "))
    rows = table(spark, folder, "benchmark").select(
        "item_id", M.identity(front, F.col("text"), F.array(F.lit("Nobody"), F.lit("Li")), F.lit(False)).alias("i")
    )
    return rows.select("item_id", "i.overlap", "i.accepted")


@queries("""SELECT c_custkey, 'Lot ' || c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '$' || c_custkey ELSE c_custkey || ' USD' END AS price, CASE
WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS description,
CASE WHEN c_custkey % 4 = 0 THEN 'Used - Good' ELSE 'Odd Thing' END AS condition, CASE WHEN c_custkey % 3 > 0 THEN 'complete' ELSE 'incomplete' END AS status FROM customer""")
def listing_record(spark, folder):
    from sheaf.operators.verdict import listing_status

    k = F.col("c_custkey")
    first = F.to_json(
        F.struct(
            F.struct(k.cast("string").alias("amount"), F.lit("USD").alias("currency")).alias("listing_price"),
            F.when(k % 2 == 0, F.struct(F.concat(F.lit("$"), k.cast("string")).alias("text"))).alias("formatted_price"),
            F.lit(" ").alias("marketplace_listing_title"), F.when(k % 4 == 0, "PC_USED_GOOD").otherwise("PC_ODD_THING").alias("condition")
        )
    )
    second = F.to_json(
        F.struct(
            F.concat(F.lit("Lot "), F.col("c_name")).alias("marketplace_listing_title"),
            F.when(k % 3 > 0, F.struct(F.col("c_mktsegment").alias("text"))).alias("redacted_description")
        )
    )
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.posexplode(F.array(first, second)).alias("pos", "json")
    ).withColumn("fields", M.listing(F.col("json")))
    found = M.merged_listing(rows, "c_custkey", "pos")
    return found.select(
        "c_custkey", "title", "price", "description", "condition",
        listing_status(F.col("title"), F.col("price"), F.col("description"), F.col("condition")).alias("status")
    )


LABELS = ("1", "1A", "1B", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "10", "11", "12", "13", "14", "15", "16")


@queries("""WITH l AS (SELECT l_orderkey, list(['1','1A','1B','2','3','4','5','6','7','7A','8','9','9A','10','11','12','13','14','15','16'][1 + (l_partkey % 20)::INT]) AS found
FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-K' WHEN '3' THEN '10-Q' WHEN '4' THEN '10-Q' END AS form, found FROM orders LEFT
JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, form, CASE form WHEN '10-K' THEN array_to_string(list_filter(['1','1A','2','3','4','5','7','7A','8','9','9A','10','11','12','13','14'],
lambda x: NOT coalesce(list_contains(found, x), false)), ',')
WHEN '10-Q' THEN array_to_string(list_filter(['1','2','3','4'], lambda x: NOT coalesce(list_contains(found, x), false)), ',') END AS missing FROM f""")
def filing_manifest(spark, folder):
    """Each order as a filing whose lines are items: some as headings, some as plain lines, in either case."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 20 + 1).cast("int"))
    line = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, "## Item ").otherwise("ITEM "), F.when(F.col("l_returnflag") == "R", F.lower(label)).otherwise(label),
        F.lit(". See item 99")
    )
    texts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    kind = F.substring("o_orderpriority", 1, 1)
    cover = F.when(kind.isin("1", "2"), "<type>10-k\n").when(kind.isin("3", "4"), "UNITED STATES\nForm 10-Q\n").otherwise("Form 8-K\n")
    rows = table(spark, folder, "orders").join(texts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select("o_orderkey", M.form_type(cover).alias("form"), M.filing_items(F.coalesce("text", F.lit(""))).alias("found"))
    return rows.select("o_orderkey", "form", F.array_join(M.missing_items(M.expected_items(F.col("form")), F.col("found")), ",").alias("missing"))
