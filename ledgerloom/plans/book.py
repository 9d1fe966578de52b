"""Collecting registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.plans import inputs, oracle

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            assert key not in self.queries, key
            self.queries[key] = query
            if sql is not None:
                self.checks[key] = oracle.check(sql)
            return query
        return register

    def scalar(self, key: str, text: str, expr: Callable[[Column], Column], sql: str) -> None:
        """A column function over an input text with the columns id and v."""
        @self.add(key, f"select id, {sql} as result from ({oracle.plain(text)}) as t")
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return inputs.derive(spark, sf_dir, text).select("id", expr(F.col("v")).alias("result"))

    def merge(self, other: Book) -> None:
        for key, query in other.queries.items():
            self.add(key)(query)
        self.checks.update(other.checks)
