"""Registration of queries and access to the tables they run on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.session import ship_package
from tilescope.sources import tables
from tilescope.sources.views import with_views

# Dates of the three scenes in the tiles view.
D1, D2, D3 = DATES = ["2023-12-08", "2024-05-16", "2024-12-17"]


@dataclass
class Data:
    """The tables under one folder, opened when first used."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self._open: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        return tables.view(self.spark, self.root, name, self._open)

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL over views or tables, named `{like_this}`."""
        return self.spark.sql(text, **{n: self.view(n) for n in names})

    @cached_property
    def tiles(self) -> DataFrame:
        return self.view("tiles")

    @cached_property
    def points(self) -> DataFrame:
        return self.view("points")

    @cached_property
    def raster(self) -> DataFrame:
        return self.view("raster")

    @cached_property
    def scenes(self) -> DataFrame:
        return tables.with_affine(self.view("scenes"))

    @cached_property
    def tile_points(self) -> DataFrame:
        return tables.with_bounds(self.view("tile_points"))

    def vectors(self, ids: list[int]) -> list[list[float]]:
        """Stored vectors by id, in the order asked for: a handful of model vectors."""
        rows = self.table("embeddings").filter(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
        found = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in rows}
        return [found[i] for i in ids]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register fn(Data) -> DataFrame under a name, with its DuckDB text."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = None if sql is None else (with_views(sql, *views) if views else sql.strip())
        REGISTRY[name] = Query(lambda spark, root: fn(Data(ship_package(spark), root)), text)
        return fn

    return add


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six decimals, so that summation order does not show."""
    out = F.round(column, 6)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def text_of(column: Column | str) -> Column:
    """Timestamp as text, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
