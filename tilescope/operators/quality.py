"""Unit scaling, grey levels and cloud / shadow screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions.ranking import join_small


def to_unit(
    pixels: DataFrame, tile_keys: Sequence[str], bands: Sequence[str], full_scale: float = 255.0
) -> DataFrame:
    """Scale bands to [0, 1]; a tile whose maximum exceeds 1 is divided by `full_scale`.

    Tile maxima combine before the shuffle and come back as a small table, so
    pixels stay where they are.
    """
    top = F.greatest(*[F.col(b) for b in bands]) if len(bands) > 1 else F.col(bands[0])
    peaks = pixels.groupBy(*tile_keys).agg(F.max(top).alias("__peak"))
    divisor = F.when(F.col("__peak") > 1.0, F.lit(full_scale)).otherwise(F.lit(1.0))
    scaled = {b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(b) / divisor)) for b in bands}
    return join_small(pixels, peaks, tile_keys).withColumns(scaled).drop("__peak")


def grey(bands: Sequence[str]) -> Column:
    """Mean of the first three bands; a single band stands for all three."""
    used = [F.col(b) for b in bands[:3]]
    return sum(used[1:], used[0]) / len(used)


def cloud_ratio(
    pixels: DataFrame, tile_keys: Sequence[str], level: Column, rules: config.QualityRules = config.QualityRules()
) -> DataFrame:
    """Share of very bright or very dark pixels per tile, from unit grey levels."""
    murky = (level >= rules.cloud) | (level <= rules.shadow)
    return pixels.groupBy(*tile_keys).agg(F.avg(murky.cast("double")).alias("cloud_ratio"))


def scl_cloud_ratio(pixels: DataFrame, tile_keys: Sequence[str], scl: str = "scl") -> DataFrame:
    """Share of scene-classification codes that mean cloud or shadow."""
    murky = F.col(scl).isin(*config.SCL_CLOUDY)
    return pixels.groupBy(*tile_keys).agg(F.avg(murky.cast("double")).alias("cloud_ratio"))


def suppression_reason(cloud_t1: Column, cloud_t2: Column, max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO) -> Column:
    """Why a pair is not compared; null when it is. T1 is tested first."""
    return F.when(cloud_t1 > max_ratio, F.lit(config.T1_SUPPRESSED)).when(
        cloud_t2 > max_ratio, F.lit(config.T2_SUPPRESSED)
    )
