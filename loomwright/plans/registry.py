"""How query modules register a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(query: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = query
            if sql:
                self.oracle[name] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
