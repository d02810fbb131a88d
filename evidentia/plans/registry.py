"""How a module of plans registers its queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"a query named twice: {f.__name__}")
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
