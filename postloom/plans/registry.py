"""Registry of queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postloom.plans.views import VIEWS

Query = Callable[["Source"], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MARK = re.compile(r"<<(\w+)>>")


class Source:
    """The supplied tables of one folder, and the posting-shaped views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Rows for a query's input, from SQL over ``<<table>>`` and ``<<view>>`` marks."""

        def expand(match: re.Match) -> str:
            inner = match[1]
            if inner in VIEWS:
                return f"({_MARK.sub(expand, VIEWS[inner])})"
            return f"parquet.`{self.folder}/{inner}.parquet`"

        return self.spark.sql(_MARK.sub(expand, text))


def _portable(text: str) -> str:
    def expand(match: re.Match) -> str:
        inner = match[1]
        return f"({_MARK.sub(expand, VIEWS[inner])})" if inner in VIEWS else inner

    return _MARK.sub(expand, text)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is ANSI SQL with the same ``<<table>>`` and ``<<view>>`` marks."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = _portable(oracle)
        return fn

    return add


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Source(spark, folder))

    return {name: bind(fn) for name, fn in QUERIES.items()}
