"""Registry of named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, tuple[str, ...]] = {}

    def add(self, sql: str | None = None, covers: tuple[str, ...] = ()):
        """Decorator: a function of Tables becomes the query of its name. covers: ids of the survey's inventory."""

        def wrap(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            self.covers[f.__name__] = covers
            return f

        return wrap
