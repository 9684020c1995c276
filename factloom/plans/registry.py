"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Read:
    """The tables of a folder, each read when it is asked for: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Read`` under its name."""

    def put(f: Callable[[Read], DataFrame]) -> Callable[[Read], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Read(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
