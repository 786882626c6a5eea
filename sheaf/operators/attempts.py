"""Choosing among attempts at one document: failure classes, escalation, first success, replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSIENT = (429, 500, 502, 503, 504)
TRIES = 4


def is_transient(status: Column) -> Column:
    """Whether trying again may help."""
    return status.isin(*TRANSIENT)


def retry_delay(status: Column, attempt: Column, tries: int = TRIES) -> Column:
    """Seconds until the next try: 1, 2, 4 after transient failures; null where there is none."""
    return F.when(is_transient(status) & (attempt < tries), F.pow(F.lit(2.0), attempt - 1).cast("int"))


def failure(auth: Column, blocked: Column, paginated: Column, status: Column) -> Column:
    """auth before block before pagination before verification; null for a complete capture."""
    return F.when(auth, "auth").when(blocked, "block").when(paginated, "pagination").when(status == "complete", None).otherwise("verification")


def should_render(failed: Column, status: Column, shell: Column) -> Column:
    """Whether a rendered capture may do better: never after auth or pagination, always after a block, and for script shells that gave nothing certain."""
    return F.coalesce(
        F.when(failed.isin("auth", "pagination"), False).when(failed == "block", True).otherwise(
            shell & ((failed == "extraction") | ((failed == "verification") & (status == "unknown")))
        ),
        F.lit(False)
    )


def should_authenticate(tier: Column, error: Column, status: Column, failed: Column) -> Column:
    return F.coalesce((tier != 4) & error.isNull() & (status != "complete") & failed.isin("auth", "block", "verification"), F.lit(False))


def render_improved(old: Column, new: Column) -> Column:
    """Whether a rendered attempt replaces a static one. Both: struct(error, fetched, extracted, failure, policy)."""
    usable = new["error"].isNull() & new["fetched"] & new["extracted"]
    return F.coalesce(usable & ~((old["failure"] == "block") & (new["failure"] == "block") & ~new["policy"]), F.lit(False))


def choose_authenticated(auth: Column) -> Column:
    """``auth`` or ``anonymous``, by the authenticated attempt: struct(error, status, policy, fetched, blocked, blank). Length is no reason."""
    return F.when(auth["error"].isNotNull(), "anonymous").when(auth["status"] == "complete", "auth").when(
        auth["policy"] | ~auth["fetched"] | auth["blocked"] | auth["blank"], "anonymous"
    ).otherwise("auth")


def first_success(attempts: DataFrame, key: str, order: list[str], accepted: Column, columns: list[str]) -> DataFrame:
    """Each key's first accepted attempt by ``order``: one aggregation with map-side combining."""
    return attempts.where(accepted).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first")).select(key, "first.*")


def replaced(registry: DataFrame, name: str = "name") -> DataFrame:
    """One entry for each name: the highest priority, of equal ones the latest registered. One aggregation that combines in the map tasks."""
    rest = [c for c in registry.columns if c != name]
    best = registry.groupBy(name).agg(F.max_by(F.struct(*rest), F.struct("priority", "seq")).alias("_best"))
    return best.select(*(F.col(name) if c == name else F.col(f"_best.`{c}`").alias(c) for c in registry.columns))


def redirect_chain(starts: DataFrame, hops: DataFrame, most: int = 3) -> DataFrame:
    """(url, final, hops, looped): follow (from_url, to_url) rows at most ``most`` times; a URL seen before ends the chain.

    Of several hops from one URL the least ``to_url`` is followed, so rows never multiply.
    """
    hops = hops.groupBy("from_url").agg(F.min("to_url").alias("to_url"))
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), F.array("url").alias("seen"), F.lit(False).alias("looped"))
    for _ in range(most):
        nxt = at.join(hops, (F.col("final") == F.col("from_url")) & ~F.col("looped"), "left")
        again = F.array_contains("seen", F.col("to_url"))
        go = F.col("to_url").isNotNull() & ~again
        at = nxt.select(
            "url", F.when(go, F.col("to_url")).otherwise(F.col("final")).alias("final"), (F.col("hops") + F.when(go, 1).otherwise(0)).alias("hops"),
            F.when(go, F.array_append("seen", F.col("to_url"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("looped") | F.coalesce(again, F.lit(False))).alias("looped")
        )
    return at.drop("seen")


def route(
    urls: DataFrame, recipes: list[tuple[str, int, tuple[str | Callable[[Column], Column], ...]]], url: str = "url", default: str = "generic"
) -> DataFrame:
    """Add ``recipe``: the first by priority, ties in their order, one of whose patterns or tests fits the URL. A CASE, so no join."""
    found = F.lit(default)
    for name, _, patterns in reversed(sorted(recipes, key=lambda r: -r[1])):
        match = F.lit(False)
        for p in patterns:
            match = match | F.coalesce(p(F.col(url)) if callable(p) else F.col(url).rlike(f"(?i){p}"), F.lit(False))
        found = F.when(match, name).otherwise(found)
    return urls.withColumn("recipe", found)
