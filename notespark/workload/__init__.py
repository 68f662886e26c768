"""Queries over the driver's tables, each with the same result as SQL.

Every module fills ``QUERIES`` (name -> function of session and folder) and ``ORACLE``
(name -> SQL). The driver's tables stand in for the engine's: what a course, sheet or
entry is there is stated with each query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracle[fn.__name__] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REGISTRY = Registry()


def load() -> Registry:
    from . import (  # noqa: F401
        choose_queries, document_queries, filing_queries, lookup_queries, notebook_queries, outline_queries, sheet_queries,
        text_queries,
    )

    return REGISTRY
