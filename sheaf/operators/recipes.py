"""Recipes: named routes with a DataFrame transform each, kept in an explicit registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import linkedin_class
from sheaf.operators.attempts import route
from sheaf.operators.papers import is_scholarly_input

#: The built-in recipes' URL patterns and priorities. A test in place of a pattern decides by columns.
BUILT_IN: tuple[tuple[str, int, tuple[str | Callable[[Column], Column], ...]], ...] = (
    ("reddit", 130, (r"^https?://(?:(?:www|old|new|np)\.)?reddit\.com/r/[A-Za-z0-9_]+/comments/[a-z0-9]+",)),
    ("linkedin", 120, (lambda url: url.rlike(r"(?i)^https?://(?:[a-z]{2,3}\.)?linkedin\.com/") & (linkedin_class(url) != "other"),)),
    ("facebook_marketplace", 120, (r"^https?://(?:[a-z0-9-]+\.)?facebook\.com/marketplace/item/\d+",)),
    ("sec_filings", 100, (r"^https?://(?:www\.)?sec\.gov/Archives/edgar/data/\d+/\d+/[^/?#]+\.html?(?:[?#]|$)",)),
    ("youtube", 100, (r"^https?://(?:www\.)?youtube\.com/(?:watch\?.*\bv=|shorts/|live/)", r"^https?://youtu\.be/")),
    ("academic", 90, (is_scholarly_input,)),
)


@dataclass(frozen=True)
class Recipe:
    """A route and what it does with the captures that take it."""

    name: str
    priority: int
    patterns: tuple[str | Callable[[Column], Column], ...]
    transform: Callable[[DataFrame], DataFrame] | None = None
    requires_auth: bool = False


@dataclass(frozen=True)
class Registry:
    """Recipes by name. A later one of the same name replaces an earlier one unless its priority is lower. Nothing is found or run implicitly."""

    recipes: tuple[Recipe, ...] = field(default_factory=lambda: tuple(Recipe(n, p, u) for n, p, u in BUILT_IN))

    def added(self, recipe: Recipe) -> Registry:
        if not isinstance(recipe, Recipe):
            raise TypeError("a registry holds recipes")
        old = next((r for r in self.recipes if r.name == recipe.name), None)
        if old and old.priority > recipe.priority:
            return self
        return replace(self, recipes=(*(r for r in self.recipes if r.name != recipe.name), recipe))

    def discovered(self, group: str = "sheaf.recipes") -> Registry:
        """With the recipes that installed packages name under ``group``: a recipe or a list of them each. Only this call loads them."""
        found = self
        for point in entry_points(group=group):
            loaded = point.load()
            for recipe in loaded if isinstance(loaded, (list, tuple)) else (loaded,):
                found = found.added(recipe)
        return found

    def routed(self, captures: DataFrame, url: str = "url") -> DataFrame:
        return route(captures, [(r.name, r.priority, r.patterns) for r in self.recipes], url)

    def applied(self, captures: DataFrame, generic: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Every capture by its recipe's transform, or ``generic`` where it has none. Transforms return the same columns; a ``recipe`` column that is there decides."""
        routed = captures if "recipe" in captures.columns else self.routed(captures)
        own = {r.name: r.transform for r in self.recipes if r.transform}
        parts = [t(routed.where(F.col("recipe") == n)) for n, t in own.items()]
        return reduce(DataFrame.unionByName, parts, generic(routed.where(~F.col("recipe").isin(*own)) if own else routed))


def withheld(captures: DataFrame, reason: str) -> DataFrame:
    """The record of captures that are not read without permission: an unknown status and no content."""
    return captures.select(*captures.columns, F.lit("").alias("content"), F.lit("unknown").alias("status"), F.lit(reason).alias("reason"))
