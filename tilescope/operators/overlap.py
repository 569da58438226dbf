"""Boxes that overlap: a spatial join by cells whose size follows the boxes.

A box has the level of the smallest power of two that is no less than its longer side, and meets at most four
cells of that level. Two boxes meet in cells of the larger level of theirs: every box is put into the cells of
its own level, and of the larger levels that occur on the other side, four at most of each. A pair that meets
in several cells is kept in the one that holds the lower left corner of its intersection, so it comes once.

One huge box meets a few cells that hold all others: the other side is salted, so such a cell is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.ranking import top_per_key
from tilescope.session import written

SALTS = 16
LEVELS = range(-40, 41)  # cells from 2**-40 to 2**40


def _level(bounds: Column) -> Column:
    side = F.greatest(bounds[2] - bounds[0], bounds[3] - bounds[1], F.lit(2.0 ** LEVELS[0]))
    return F.ceil(F.log2(side)).cast("int")


def _cells(boxes: DataFrame, levels: Column) -> DataFrame:
    """A row for every cell that a box meets on each of some levels."""
    at = boxes.withColumn("level", F.explode(levels)).withColumn("cell", F.pow(F.lit(2.0), F.col("level")))

    def numbers(low: int, high: int) -> Column:
        low_cell, high_cell = (F.floor(F.col("b")[k] / F.col("cell")).cast("long") for k in (low, high))
        return F.explode(F.sequence(low_cell, high_cell))

    return at.withColumn("cx", numbers(0, 2)).withColumn("cy", numbers(1, 3))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of boxes of left(left_id, bounds) and right(right_id, bounds) that touch or overlap.

    bounds is array(left, bottom, right, top). Boxes with a null or non-finite bound, or turned inside out, meet none.
    """

    def clean(df: DataFrame, key: str) -> DataFrame:
        b = F.col("bounds").cast("array<double>")
        sound = (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        df = df.select(key, b.alias("b")).filter(sound).filter((F.col("b")[0] <= F.col("b")[2]) & (F.col("b")[1] <= F.col("b")[3]))
        return written(df.withColumn("own", _level(F.col("b"))))

    a, c = clean(left, "left_id"), clean(right, "right_id")

    def levels(df: DataFrame) -> list[int]:
        return sorted(r["own"] for r in df.select("own").distinct().collect())  # at most len(LEVELS)

    def on(other: list[int]) -> Column:
        """A box's own level and the larger ones of the other side."""
        larger = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda x: x > F.col("own"))
        return F.array_distinct(F.concat(F.array("own"), larger))

    on_a, on_c = levels(a), levels(c)
    a = _cells(a.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), on(on_c))
    c = _cells(c.withColumn("salt", F.pmod(F.xxhash64("right_id"), F.lit(SALTS)).cast("int")), on(on_a))
    a = a.select("left_id", "salt", "level", "cx", "cy", F.col("b").alias("a"), F.col("own").alias("own_a"))
    # The optimizer knows the bytes of the boxes, not of their cells, and would broadcast these by the salt and cell.
    met = a.join(c.hint("merge"), ["salt", "level", "cx", "cy"]).filter(F.col("level") == F.greatest("own_a", "own"))
    met = met.filter((F.col("a")[0] <= F.col("b")[2]) & (F.col("b")[0] <= F.col("a")[2]))
    met = met.filter((F.col("a")[1] <= F.col("b")[3]) & (F.col("b")[1] <= F.col("a")[3]))
    corner_x, corner_y = (F.greatest(F.col("a")[k], F.col("b")[k]) for k in (0, 1))
    here = (F.floor(corner_x / F.col("cell")) == F.col("cx")) & (F.floor(corner_y / F.col("cell")) == F.col("cy"))
    return met.filter(here).select("left_id", "right_id")


def scenes_of_areas(
    catalogue: DataFrame, areas: DataFrame, start: str, end: str, max_cloud: float = 10.0, max_items: int = 10
) -> DataFrame:
    """(area_id, rank, scene columns): for each of areas(area_id, bounds) what scene_catalogue_search gives.

    Only different boxes meet: areas of one box share a list, and of the scenes of one box only the first max_items
    can be in any list. Each box's list is cut before its areas are looked up.
    """
    fit = catalogue.filter(F.col("date").between(start, end) & (F.col("cloud_cover") < max_cloud))
    order = [F.col("date").desc(), F.col("scene_id")]
    box = F.col("bounds").cast("array<double>")
    best = top_per_key(fit.withColumn("right_id", box), ["right_id"], order, max_items)
    members = areas.select("area_id", box.alias("left_id"))
    sides = members.select("left_id").distinct(), best.select("right_id").distinct()
    pairs = overlap_pairs(*(df.withColumn("bounds", F.col(df.columns[0])) for df in sides))
    found = top_per_key(pairs.join(best, "right_id").drop("right_id"), ["left_id"], order, max_items)
    lists = found.join(members.hint("merge"), "left_id").drop("left_id")
    return top_per_key(lists, ["area_id"], order, max_items, rank="rank")
