"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collector() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Two dictionaries and a decorator that enters a query and its SQL (None if SQL can't express it)."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None) -> Callable[[Query], Query]:
        def enter(f: Query) -> Query:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return enter

    return queries, sql, query
