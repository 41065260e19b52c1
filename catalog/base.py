"""Registry of the checked queries: a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.session import stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_STAGED: dict[tuple, DataFrame] = {}


def staged(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A derived domain table that takes ordered scans to build: written once per session and
    scale folder, so that a query over it does not rebuild it in each of its branches."""

    def get(t: Tables) -> DataFrame:
        key = (t.spark.sparkContext.applicationId, id(t.spark), t.folder, build.__name__)
        if key not in _STAGED:
            _STAGED[key] = stage_table(build(t), build.__name__)
        return _STAGED[key]

    return get


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
