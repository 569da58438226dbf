"""Reading the given tables and the imagery-shaped views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.sources.views import VIEWS


def view(spark: SparkSession, root: str, name: str, opened: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table, or a derived view built from its SQL text over tables and other views.

    `opened` keeps what was opened before, so that views sharing a table share its scan.
    """
    opened = {} if opened is None else opened
    if name not in opened:
        if name in VIEWS:
            inputs = {n: view(spark, root, n, opened) for n in VIEWS[name].inputs}
            opened[name] = spark.sql(VIEWS[name].spark, **inputs)
        else:
            opened[name] = spark.read.parquet(f"{root}/{name}.parquet")
    return opened[name]


def with_affine(scenes: DataFrame) -> DataFrame:
    """The affine transform (a, b, c, d, e, f) as one array."""
    return scenes.withColumn("affine", F.array("aff_a", "aff_b", "aff_c", "aff_d", "aff_e", "aff_f"))


def with_bounds(tiles: DataFrame) -> DataFrame:
    """Bounds as array(left, bottom, right, top)."""
    return tiles.withColumn("bounds", F.array("left_x", "bottom_y", "right_x", "top_y"))
