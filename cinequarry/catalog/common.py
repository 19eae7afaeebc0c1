"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def register(sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            queries[query.__name__] = query
            if sql is not None:
                oracles[query.__name__] = sql
            return query

        return add

    return queries, oracles, register
