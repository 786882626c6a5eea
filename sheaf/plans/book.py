"""A module's queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Book:
    def __init__(self) -> None:
        self.plans: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Register a function (spark, sf_dir) under its name."""

        def add(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.plans[plan.__name__] = plan
            if sql:
                self.sql[plan.__name__] = sql
            return plan

        return add
