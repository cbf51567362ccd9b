"""Registry of queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternwatch.sources.calls import CALLS_SQL, calls_from_events
from lanternwatch.streaming.shared import parts, settled  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, calls_sql: bool = False):
    """Registers a query; ``calls_sql`` puts the view of calls before the oracle's SELECT."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = f"WITH calls AS ({CALLS_SQL}) {oracle}" if calls_sql else oracle
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are scanned at length. A file of few row groups is dealt to all cores first; a large table has splits enough."""
    rows, cores = table(spark, sf, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 4 * cores else rows.repartition(4 * cores)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return calls_from_events(table(spark, sf, "events"))
