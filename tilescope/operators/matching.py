"""Histogram matching of a later image to an earlier one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_table(pixels: DataFrame, keys: Sequence[str], side: str, value: str) -> DataFrame:
    """For every T2 value of a tile band, the T1 value at the same cumulative share.

    `side` is 1 for the template (T1) and 2 for the image to change (T2).
    Pixels are reduced to counts per value before any window runs; a window then
    holds one tile band's distinct values. Between template values the result is
    linear in the cumulative share, and it stops at the template's ends.
    """
    keys = list(keys)
    tally = pixels.groupBy(*keys, side, value).agg(F.count(F.lit(1)).alias("n"))
    by_side = Window.partitionBy(*keys, side)
    share = F.sum("n").over(by_side.orderBy(value)) / F.sum("n").over(by_side)
    curve = tally.withColumn("q", share)

    along = Window.partitionBy(*keys).orderBy("q")
    so_far = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = along.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    template = F.col(side) == 1
    t_value, t_share = F.when(template, F.col(value)), F.when(template, F.col("q"))
    around = curve.select(
        *keys,
        side,
        F.col(value).alias("source_value"),
        "n",
        "q",
        F.max(t_value).over(so_far).alias("v0"),
        F.max(t_share).over(so_far).alias("q0"),
        F.min(t_value).over(ahead).alias("v1"),
        F.min(t_share).over(ahead).alias("q1"),
    )
    step = (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0"))
    matched = (
        F.when(F.col("v0").isNull(), F.col("v1"))
        .when(F.col("v1").isNull() | (F.col("q1") == F.col("q0")), F.col("v0"))
        .otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * step)
    )
    return around.filter(F.col(side) == 2).select(*keys, "source_value", "n", matched.alias("matched_value"))


def apply_match(pixels: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Replace T2 pixel values by their matched values."""
    lookup = table.select(*keys, F.col("source_value").alias(value), "matched_value")
    return pixels.join(lookup, [*keys, value])


def match_images(
    first: DataFrame, second: DataFrame, tile_keys: Sequence[str], bands: Sequence[str], y: str = "y", x: str = "x"
) -> DataFrame:
    """The second image with each of its first three bands matched to the first image, tile by tile.

    Bands travel as rows, so one match table serves them all.
    """
    used = list(bands[:3])
    place = [*tile_keys, y, x]

    def long(pixels: DataFrame, side: int) -> DataFrame:
        values = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in used])
        return pixels.select(*place, F.inline(values)).withColumn("side", F.lit(side))

    after = long(second, 2)
    table = match_table(long(first, 1).unionByName(after), [*tile_keys, "band"], "side", "value")
    matched = apply_match(after, table, [*tile_keys, "band"], "value")
    return matched.groupBy(*place).agg(
        *[F.max(F.when(F.col("band") == b, F.col("matched_value"))).alias(b) for b in used]
    )
