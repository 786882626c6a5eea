"""Discussion pages: a thread's comments from the markup of a mirror, then ranking, budget and verdict without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import count_tokens
from sheaf.operators.dom import BOILERPLATE, DROPPED, MOST_DIGITS, Node, Tree, content_scope, sections_of, squash
from sheaf.operators.threads import CORE_LIMIT, capture_status

#: Fixed value: the URLs of threads.
THREAD = re.compile(r"^https?://(?:(?:www|old|new|np)\.)?reddit\.com/r/([A-Za-z0-9_]+)/comments/[a-z0-9]+", re.I)
Test = Callable[[Node], bool]


def classed(name: str) -> Test:
    return lambda n: name in n.get("class").split()


def class_has(part: str) -> Test:
    return lambda n: part in n.get("class")


def tagged(tag: str) -> Test:
    return lambda n: n.tag == tag


def within(outer: Test, inner: Test) -> Test:
    def test(node: Node) -> bool:
        at = node.parent if inner(node) else None
        while at and not outer(at):
            at = at.parent
        return at is not None

    return test


#: Where each field stands, the first place that is there first.
TITLE = (classed("post_title"), classed("post-title"), tagged("h1"), tagged("title"))
POST_TIME = (
    classed("post_time"), classed("post-time"), within(classed("post"), classed("created")), within(classed("post"), class_has("time")),
    within(tagged("article"), tagged("time"))
)
BODY = (classed("comment_body"), classed("comment-body"), classed("comment_content"), classed("comment-content"), classed("md"))
SCORE = (classed("comment_score"), classed("comment-score"), class_has("score"))
TIME = (tagged("time"), classed("comment_time"), classed("comment-time"), classed("created"), class_has("timestamp"))
AUTHOR = (classed("comment_author"), classed("comment-author"), class_has("author"))


def chosen(root: Node, places: tuple[Test, ...]) -> Node | None:
    """The first node in the first place that any node is in."""
    below = [n for n in root.walk() if n is not root]
    return next((n for place in places for n in below if place(n)), None)


def score_of(text: str) -> int | None:
    """The first number in a text, thousands and millions by their letters; null where it is none or beyond ``MOST_DIGITS`` digits."""
    found = re.search(r"([-+]?[0-9][0-9,.]*)([kKmM]?)", text)
    try:
        value = float(found[1].replace(",", "")) * {"": 1, "k": 1_000, "m": 1_000_000}[found[2].lower()] if found else None
    except ValueError:
        return None
    return None if value is None or abs(value) >= 10**MOST_DIGITS else round(value)


def comments_of(root: Node) -> Iterator[dict[str, Any]]:
    """Comments with a body, in document order. One without an id is named by its place among all."""
    for place, node in enumerate(filter(classed("comment"), root.walk()), 1):
        at = {k: chosen(node, places) for k, places in (("body", BODY), ("score", SCORE), ("time", TIME), ("author", AUTHOR))}
        text = {k: squash(n.text()) if n else "" for k, n in at.items()}
        if text["body"]:
            stamp = at["time"] and (at["time"].get("datetime") or at["time"].get("title"))
            yield {
                "id": node.get("id") or node.get("data-id") or f"captured-{place}", "body": text["body"], "score": score_of(text["score"]),
                "timestamp": stamp or None, "age": text["time"] or None, "author": text["author"] if at["author"] else None
            }


NO_THREAD = dict.fromkeys(("title", "subreddit", "post_age", "reported", "deeper", "comments"))


def thread(html: str | None, url: str | None) -> dict[str, Any]:
    """A thread of one page. A URL that is not a thread's gives an error, and so does a page that can't be read."""
    named = THREAD.search(url or "")
    if not named:
        return NO_THREAD | {"error": "the URL is not a thread's"}
    try:
        return parsed_thread(html, named)
    except Exception as e:  # one page must not end a job over many
        return NO_THREAD | {"error": f"the page can't be read: {type(e).__name__}"}


def parsed_thread(html: str | None, named: re.Match) -> dict[str, Any]:
    tree = Tree(html or "")
    root = tree.root
    shown = (content_scope(tree.nodes) or next(root.all("body"), root)).text(DROPPED | BOILERPLATE, hide=True)
    counts = [int(digits) for n in re.findall(r"\b([0-9,]+)\s+comments?\b", shown, re.I) if 0 < len(digits := n.replace(",", "")) <= MOST_DIGITS]
    title, age = chosen(root, TITLE), chosen(root, POST_TIME)
    return {
        "title": re.sub(r"\s*[-|]\s*Redlib\s*$", "", squash(title.text()) if title else "", flags=re.I) or "Reddit thread",
        "subreddit": named[1],
        "post_age": squash(age.text()) if age else None,
        "reported": max(counts, default=None),
        "deeper": sum(1 for n in root.all("a") if "deeper_replies" in n.get("class").split()),
        "comments": list(comments_of(root)),
        "error": None,
    }


THREAD_TYPE = "title string, subreddit string, post_age string, reported long, deeper int, comments array<struct<id:string,body:string,score:long,timestamp:string,age:string,author:string>>, error string"
OUTLINE_TYPE = "array<struct<heading:string,level:int,anchor:string,token_count:long,char_count:int>>"


def _threads(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [thread(h, u) for h, u in zip(html, url, strict=True)]
    out = pd.DataFrame(rows, columns=["title", "subreddit", "post_age", "reported", "deeper", "comments", "error"])
    return out.astype({"reported": "Int64", "deeper": "Int32"})


def with_threads(captures: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add ``thread``: each page parsed once."""
    return captures.withColumn("thread", F.pandas_udf(_threads, THREAD_TYPE)(F.col(html), F.col(url)))


def _outlines(markdown: pd.Series) -> pd.Series:
    return pd.Series(
        [[{k: c[k] for k in ("heading", "level", "anchor", "token_count", "char_count")} for c in sections_of(m or "")] for m in markdown]
    )


def header_markdown(t: Column) -> Column:
    """A thread's title and counts."""
    lines = F.array(
        F.concat(F.lit("# "), t["title"]),
        F.concat(F.lit("Subreddit: r/"), t["subreddit"]),
        F.concat(F.lit("Reported comments: "), F.coalesce(t["reported"].cast("string"), F.lit("unknown"))),
        F.concat(F.lit("Unloaded reply subtrees: "), t["deeper"].cast("string")),
        F.concat(F.lit("Post age: "), F.nullif(t["post_age"], F.lit(""))),
    )
    return F.array_join(F.array_compact(lines), "\n\n")


def comment_markdown(c: Column) -> Column:
    """A comment under its own heading, its facts in one line and its body quoted."""
    label = lambda name, value: F.concat(F.lit(f"{name}: "), F.nullif(value, F.lit("")))
    facts = F.array_compact(
        F.array(
            F.concat(F.lit("Score: "), F.coalesce(c["score"].cast("string"), F.lit("unknown"))), label("Author", c["author"]),
            label("Timestamp", c["timestamp"]), label("Age", c["age"])
        )
    )
    return F.concat(F.lit("## Comment "), c["id"], F.lit("\n\n"), F.array_join(facts, " | "), F.lit("\n\n> "), c["body"])


def comment_anchor(identifier: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(identifier), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("comment-"), F.when(plain == "", "captured").otherwise(plain))


def thread_results(captures: DataFrame, budget: int | None = None, limit: int = CORE_LIMIT, full: bool = False) -> DataFrame:
    """One result for each captured thread: content, outline, status, coverage, truncated, omitted, cost_to_complete, structured_data.

    Comments with scores come first, greater ones before, ties in their order. The longest prefix within the
    limit and the budget is kept; with ``full`` all are. The outline is of all comments, and unloaded replies
    count as remaining items. A page's comments stay in one array, so nothing is shuffled. Pages that are not
    threads have an error, an unknown status and no content.
    """
    if isinstance(limit, bool) or limit < 1:
        raise ValueError("the limit must be positive")
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int) or budget < 0):
        raise ValueError("the budget must be a non-negative integer")
    t = F.col("thread")
    rows = with_threads(captures)
    order = F.transform(
        "thread.comments", lambda c,
        i: F.struct(c["score"].isNull().alias("none"), (-c["score"]).alias("less"), i.alias("i"), c.alias("c"), comment_markdown(c).alias("block"))
    )
    rows = rows.withColumns({"header": header_markdown(t), "ranked": F.sort_array(order)})
    most = F.size("ranked") if full else F.least(F.lit(limit), F.size("ranked"))
    head = count_tokens(F.col("header")).cast("long")
    state = F.struct(head.alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("on"))

    def fit(s: Column, r: Column) -> Column:
        used = s["used"] + count_tokens(r["block"])
        on = s["on"] & (used <= F.lit(budget))
        return F.struct(
            F.when(on, used).otherwise(s["used"]).cast("long").alias("used"), F.when(on, s["kept"] + 1).otherwise(s["kept"]).alias("kept"),
            on.alias("on")
        )

    free = full or budget is None
    rows = rows.withColumns(
        {
            "shown": F.lit(True) if free else head <= budget,
            "kept": most if free else F.aggregate(F.slice("ranked", F.lit(1), most), state, fit, lambda s: s["kept"])
        }
    )
    rows = rows.withColumn("kept", F.when(F.col("shown"), F.col("kept")).otherwise(0))
    blocks = lambda part: F.array_join(F.concat(F.array("header"), F.transform(part, lambda r: r["block"])), "\n\n")
    some, left = F.slice("ranked", F.lit(1), F.col("kept")), F.filter("ranked", lambda _, i: i >= F.col("kept"))
    captured, deeper = F.size("ranked"), F.col("thread.deeper")
    bad = F.col("thread.error").isNotNull()
    status = F.when(bad, "unknown").otherwise(capture_status(captured, F.col("thread.reported"), deeper))
    reason = (
        F.when(bad, F.col("thread.error"))
        .when(captured == 0, "No comment was found, so the capture can't be judged")
        .when(deeper > 0, F.concat(F.lit("Comment subtrees were not loaded: "), deeper.cast("string")))
        .when(status == "incomplete", "More comments are declared than were captured")
        .otherwise("All declared comments were captured")
    )
    extra = F.aggregate(left, F.lit(0).cast("long"), lambda a, r: a + count_tokens(r["block"]))
    data = F.struct(
        "thread.subreddit", "thread.post_age", F.col("thread.reported").alias("reported_comment_count"), captured.alias("captured_comment_count"),
        deeper.alias("deeper_reply_count"), F.transform(some, lambda r: r["c"].dropFields("body")).alias("comments")
    )
    ids = [c for c in captures.columns if c not in ("html", "url")]
    return rows.select(
        *ids,
        "url",
        F.when(~bad & F.col("shown"), blocks(some)).otherwise("").alias("content"),
        F.pandas_udf(_outlines, OUTLINE_TYPE)(F.when(~bad, blocks(F.col("ranked")))).alias("outline"),
        status.alias("status"),
        reason.alias("reason"),
        F.when(F.size(left) > 0, "core").otherwise("full").alias("coverage"),
        (F.size(left) > 0).alias("truncated"),
        F.coalesce(F.transform(left, lambda r: comment_anchor(r["c"]["id"])), F.array().cast("array<string>")).alias("omitted"),
        F.when(
            ~bad & ((F.size(left) > 0) | (deeper > 0)),
            F.struct((F.size(left) + deeper).alias("remaining_items"), extra.alias("estimated_extra_tokens"), F.lit(2).alias("required_tier"))
        ).alias("cost_to_complete"),
        F.when(~bad, data).alias("structured_data"),
    )
