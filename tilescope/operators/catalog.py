"""Scene catalogue search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersects(bounds: Column, area: Sequence[float]) -> Column:
    """Whether array(left, bottom, right, top) meets an area of the same form."""
    left, bottom, right, top = area
    return (bounds[0] <= right) & (bounds[2] >= left) & (bounds[1] <= top) & (bounds[3] >= bottom)


def scene_catalogue_search(
    catalogue: DataFrame,
    area: Sequence[float],
    start: str,
    end: str,
    max_cloud: float = 10.0,
    max_items: int = 10,
) -> DataFrame:
    """Scenes that meet the area, fall between the dates and are clear enough, newest first."""
    return (
        catalogue.filter(
            intersects(F.col("bounds"), area) & F.col("date").between(start, end) & (F.col("cloud_cover") < max_cloud)
        )
        .orderBy(F.col("date").desc(), "scene_id")
        .limit(max_items)
    )
