"""The tier ladder over captured attempts: a page read statically, rendered, and with its user's sign-in, and which of them counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import attempts as A
from sheaf.operators.dom import looks_like_shell
from sheaf.operators.verdict import evidence
from sheaf.plans.captures import POLICY, RENDER_MS, check_budget, error, header, results_of, verified

STATIC, RENDERED, SIGNED_IN = 1, 2, 4
#: What the choice needs to know of an attempt.
FACTS = ("tier", "error", "fetched", "extracted", "failure", "status", "policy", "blocked", "blank", "shell")


def judged_attempts(captures: DataFrame, covered: bool = False) -> DataFrame:
    """Captures with a ``tier``, verified each by itself, and ``attempt``, the struct of ``FACTS``.

    A capture that failed has ``error`` set in its row; a status that is no success without a block page is a
    retrieval error, and a page without content an extraction error. Errors are values, so no attempt ends a job.
    """
    have = set(captures.columns)
    lost = F.col("_lost.message") if "_lost" in have else F.lit(None).cast("string")
    rows = verified(captures, covered)
    status, blocked = F.col("http_status"), F.col("block.detected")
    refused = F.coalesce(~status.between(200, 299), F.lit(False)) & ~blocked
    blank = F.trim("facts.markdown") == ""
    wrong = (
        F.when(lost.isNotNull(), error("retrieval", lost))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(refused, error("retrieval", F.concat(F.lit("the status is "), status.cast("string"))))
        .when(blank & ~blocked, error("extraction", "the page has no content"))
    )
    kind = F.when(wrong["kind"].isin("retrieval", "extraction"), wrong["kind"]).otherwise(F.col("failure"))
    policy = header(have, POLICY).isNotNull()
    rows = rows.withColumns({"error": wrong, "failure": kind})
    known = {
        "tier": F.col("tier"), "error": F.col("error.message"), "fetched": lost.isNull(), "extracted": lost.isNull() & ~refused,
        "failure": F.col("failure"), "status": F.when(F.col("error").isNull(), F.col("status")), "policy": policy, "blocked": blocked, "blank": blank,
        "shell": F.coalesce(looks_like_shell(F.col("html")), F.lit(False))
    }
    return rows.withColumn("attempt", F.struct(*(known[k].alias(k) for k in FACTS)))


def chosen_tier(static: Column, rendered: Column, signed: Column, required: Column) -> Column:
    """struct(tier, next, policy): the tier whose attempt counts, the tier to capture next, and whether a browser's policy spoke against signing in.

    A rendered attempt is asked for after a block and for script shells, a signed-in one after what a sign-in may
    cure. Each attempt keeps its own verdict, so a choice never turns a partial capture into a complete one.
    """
    render = A.should_render(static["failure"], static["status"], static["shell"])
    better = render & rendered.isNotNull() & A.render_improved(static, rendered)
    open_one = F.when(better, rendered).otherwise(static)
    more = A.should_authenticate(open_one["tier"], open_one["error"], open_one["status"], open_one["failure"])
    signed_in = more & signed.isNotNull() & (A.choose_authenticated(signed) == "auth")
    refused = more & signed.isNotNull() & signed["policy"] & signed["error"].isNull() & F.coalesce(signed["status"] != "complete", F.lit(True))
    tier = F.when(required, signed["tier"]).when(signed_in, signed["tier"]).otherwise(open_one["tier"])
    ahead = F.when(required, F.when(signed.isNull(), SIGNED_IN)).when(render & rendered.isNull(), RENDERED).when(more & signed.isNull(), SIGNED_IN)
    return F.struct(tier.alias("tier"), ahead.alias("next"), (refused & ~signed_in & ~required).alias("policy"))


def read_ladder(captures: DataFrame, budget: int | None = None, key: str = "url", required: Column | None = None, covered: bool = False) -> DataFrame:
    """One result for each ``key``, of the tier that counts: the columns of ``read_captures``, ``next_tier`` and ``completion``.

    ``captures`` has url, html and ``tier`` (1 static, 2 rendered, 4 signed in); of several of one tier the one of
    the greatest ``fetched_at`` counts, and rows of other tiers take no part. An ``error`` column tells that a
    capture failed. ``required``: whether a URL is read signed in or not at all. One aggregation by key, which
    combines in the map tasks, brings a key's attempts together as they were captured; they are parsed after it, and
    the choice needs no other shuffle.
    """
    check_budget(budget)
    if "error" in captures.columns:
        captures = captures.withColumnRenamed("error", "_lost")
    must = F.lit(False) if required is None else F.coalesce(required, F.lit(False))
    have = set(captures.columns)
    when = F.coalesce(F.col("fetched_at"), F.lit("")) if "fetched_at" in have else F.lit("")
    own = Window.partitionBy(key)
    rest = F.struct(*(c for c in captures.columns if c != key))
    newest = [F.max_by(rest, F.when(F.col("tier") == t, F.struct(when, F.coalesce("html", F.lit(""))))) for t in (STATIC, RENDERED, SIGNED_IN)]
    few = captures.groupBy(key).agg(F.array_compact(F.array(*newest)).alias("_tries")).select(key, F.explode("_tries").alias("_c"))
    latest = judged_attempts(few.select(key, "_c.*").select(*captures.columns), covered)
    of = lambda tier: F.max(F.when(F.col("tier") == tier, F.col("attempt"))).over(own)
    seen = latest.withColumns({"_static": of(STATIC), "_rendered": of(RENDERED), "_signed": of(SIGNED_IN), "_must": must})
    ranked = seen.withColumn("_choice", chosen_tier(F.col("_static"), F.col("_rendered"), F.col("_signed"), F.col("_must")))
    # a key whose static attempt is missing is read from the lowest tier there is
    tier = F.coalesce("_choice.tier", F.min("tier").over(own))
    kept = ranked.withColumn("_tier", tier).where(F.col("tier") == F.col("_tier"))
    closed = F.col("_must") & F.col("_signed").isNull()  # what must be read signed in is not read without
    kept = kept.withColumns(
        {
            "block": F.col("block").withField("auth_required", F.col("block.auth_required") | closed),
            "failure": F.when(closed, "auth").otherwise(F.col("failure"))
        }
    )
    auth = F.col("failure") == "auth"
    kept = kept.withColumns(
        {
            "evidence": F.when(closed, evidence(persistent_profile=F.lit(False))).when(
                F.col("_choice.policy"), F.concat("evidence", evidence(browser_policy=F.lit(False)))
            ).otherwise(F.col("evidence")),
            "reason": F.when(
                auth & (F.col("tier") == SIGNED_IN), "A sign-in is required, and the one that is stored did not clear the wall"
            ).when(auth, "A sign-in is required, and none is stored").otherwise(F.col("reason")),
            "status": F.when(auth | F.col("error").isNotNull(), "unknown").otherwise(F.col("status")),
        }
    )
    kept = kept.withColumn("next_tier", F.col("_choice.next"))
    took = header(have, RENDER_MS)
    base = captures.drop("tier", "headers", *(["_lost"] if "_lost" in have else [])).withColumn("next_tier", F.lit(None).cast("int"))
    return results_of(kept, base, budget, F.col("tier"), F.when(took.rlike("^[0-9]{1,9}$"), took.cast("int")))
