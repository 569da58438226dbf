"""Queries of this subpackage, apart from those of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilescope.plans.registry import Query
from tilescope.session import ship_package

REGISTRY: dict[str, Query] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def query(name: str, sql: str | None = None):
    """Register fn(spark, folder) -> DataFrame under a name, with its DuckDB text where there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(lambda spark, folder: fn(ship_package(spark), folder), sql)
        return fn

    return add
