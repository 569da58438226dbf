"""Spectral indices, pixel differences, display scaling and the written summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions.ranking import join_small


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (a - b) / (a + b + config.INDEX_EPSILON)


def indices() -> dict[str, Column]:
    """Vegetation, built-up and water index from bands b03, b04, b08, b11."""
    return {
        "ndvi": normalized_difference("b08", "b04"),
        "ndbi": normalized_difference("b11", "b08"),
        "ndwi": normalized_difference("b03", "b08"),
    }


def index_change(pixels: DataFrame, tile_keys: Sequence[str], time: str = "t") -> DataFrame:
    """Mean of each index per tile at both dates, and the change between them.

    One aggregation with conditional means; pixels of the two dates need no join.
    """
    means, changes = [], []
    for name, index in indices().items():
        for t in (1, 2):
            means.append(F.avg(F.when(F.col(time) == t, index)).alias(f"{name}_t{t}"))
        changes.append((F.col(f"{name}_t2") - F.col(f"{name}_t1")).alias(f"{name}_change"))
    return pixels.groupBy(*tile_keys).agg(*means).select("*", *changes)


def cloud_change(pixels: DataFrame, tile_keys: Sequence[str], time: str = "t", scl: str = "scl") -> DataFrame:
    return pixels.groupBy(*tile_keys).agg(*cloud_shares(time, scl))


def cloud_shares(time: str = "t", scl: str = "scl") -> list[Column]:
    """Cloud percentages of both dates: a hundred times the share, as the texts round it."""
    murky = F.col(scl).isin(*config.SCL_CLOUDY).cast("double")
    return [(F.avg(F.when(F.col(time) == t, murky)) * 100).alias(f"cloud_pct_t{t}") for t in (1, 2)]


def pixel_difference(first: DataFrame, second: DataFrame, pixel_keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Mean absolute band difference of every pixel present on both dates; diff_sum and diff_bands are what it is made of."""
    a = first.select(*pixel_keys, *[F.col(b).alias(f"{b}_1") for b in bands])
    b = second.select(*pixel_keys, *[F.col(x).alias(f"{x}_2") for x in bands])
    parts = [F.abs(F.col(f"{x}_2") - F.col(f"{x}_1")) for x in bands]
    total = sum(parts[1:], parts[0])
    found = a.join(b, list(pixel_keys)).select(*pixel_keys, (total / len(parts)).alias("diff"), total.alias("diff_sum"))
    return found.withColumn("diff_bands", F.when(F.col("diff_sum").isNotNull(), len(parts)))


def difference_summary(diff: DataFrame, tile_keys: Sequence[str]) -> DataFrame:
    """Mean, maximum and 98th percentile of the difference per tile (tile-bounded groups).

    The mean is taken from the band sums where they are there: those of whole numbers are exact, so a text that
    rounds a tie does not depend on the order in which thirds were added.
    """
    mean = F.sum("diff_sum") / F.sum("diff_bands") if {"diff_sum", "diff_bands"} <= set(diff.columns) else F.avg("diff")
    return diff.groupBy(*tile_keys).agg(
        mean.alias("mean_diff"),
        F.max("diff").alias("max_diff"),
        F.percentile("diff", 0.98).alias("p98"),
    )


def difference_scaled(diff: DataFrame, tile_keys: Sequence[str], epsilon: float = config.INDEX_EPSILON) -> DataFrame:
    """Differences divided by the tile's 98th percentile and clipped to [0, 1]."""
    tops = diff.groupBy(*tile_keys).agg(F.percentile("diff", 0.98).alias("__p98"))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("diff") / (F.col("__p98") + epsilon)))
    return join_small(diff, tops, tile_keys).withColumn("level", level).drop("__p98")


def percentile_stretch(
    pixels: DataFrame, tile_keys: Sequence[str], bands: Sequence[str], already_8bit: bool = False
) -> DataFrame:
    """Display bands: 2nd..98th percentile of the tile (all bands together) to 0..255."""
    if already_8bit:
        return pixels
    cuts = (
        pixels.select(*tile_keys, F.explode(F.array(*[F.col(b).cast("double") for b in bands])).alias("__v"))
        .groupBy(*tile_keys)
        .agg(F.percentile("__v", [0.02, 0.98]).alias("__cut"))
    )
    low, high = F.col("__cut")[0], F.col("__cut")[1]
    span = F.greatest(high - low, F.lit(config.INDEX_EPSILON))

    def stretch(b: str) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(b) - low) / span * 255.0))).cast("int")

    return join_small(pixels, cuts, tile_keys).withColumns({b: stretch(b) for b in bands}).drop("__cut")


def index_scale(index: Column, name: str) -> Column:
    """Index value as a share of its display range, clipped to [0, 1]."""
    low, high = config.INDEX_RANGES[name]
    span = max(high - low, config.INDEX_EPSILON)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (index - low) / span))


def _sentence(key: str, mood: str, change: Column) -> Column:
    """One sentence of the summary with the size of the change filled in.

    format_number rounds the exact binary value, as the texts require;
    format_string would round its shortest decimal form.
    """
    head, _, tail = config.NARRATIVE[key][mood].partition("{pct}")
    if not tail:
        return F.lit(head)
    return F.concat(F.lit(head), F.format_number(F.abs(change) * 100, 1), F.lit(tail))


def change_text(key: str, change: Column, strong: float = 0.1, slight: float = 0.02) -> Column:
    """Sentence for a change in the vegetation, infrastructure or water index."""
    rule = F.when(change > strong, _sentence(key, "up", change)).when(
        change < -strong, _sentence(key, "down", change)
    )
    if "slight_up" in config.NARRATIVE[key]:
        rule = rule.when(change >= slight, _sentence(key, "slight_up", change)).when(
            change <= -slight, _sentence(key, "slight_down", change)
        )
    return rule.otherwise(F.lit(config.NARRATIVE[key]["none"]))


def clarity_text(cloud_t1: Column, cloud_t2: Column, limit: float = 20.0) -> Column:
    """Sentence on cloud percentages of both dates; null if one of them is not known."""
    verdict = F.when(F.greatest(cloud_t1, cloud_t2) <= limit, F.lit(config.NARRATIVE["clear"])).otherwise(
        F.lit(config.NARRATIVE["unclear"])
    )
    return F.concat(
        F.lit("Cloud/shadow contamination: "),
        F.format_number(cloud_t1, 1),
        F.lit("% (T1) → "),
        F.format_number(cloud_t2, 1),
        F.lit("% (T2) — "),
        verdict,
    )


def change_narrative(report: DataFrame) -> DataFrame:
    """Written summary from index changes (4 decimals) and cloud percentages (1 decimal)."""
    return report.select(
        "*",
        change_text("vegetation", F.round("ndvi_change", 4)).alias("vegetation"),
        change_text("infrastructure", F.round("ndbi_change", 4)).alias("infrastructure"),
        change_text("water", F.round("ndwi_change", 4)).alias("water"),
        clarity_text(F.round("cloud_pct_t1", 1), F.round("cloud_pct_t2", 1)).alias("atmosphere"),
    )


def spectral_report(pixels: DataFrame, diff: DataFrame, tile_keys: Sequence[str], time: str = "t") -> DataFrame:
    """Indices, cloud share, pixel difference and summary per tile (multispectral mode)."""
    keys = list(tile_keys)
    measures = []
    for name, index in indices().items():
        measures += [F.avg(F.when(F.col(time) == t, index)).alias(f"{name}_t{t}") for t in (1, 2)]
    per_tile = pixels.groupBy(*keys).agg(*measures, *cloud_shares(time))
    changed = per_tile.withColumns(
        {f"{n}_change": F.round(F.round(f"{n}_t2", 4) - F.round(f"{n}_t1", 4), 4) for n in indices()}
    )
    joined = changed.join(difference_summary(diff, keys), keys)
    return change_narrative(joined).withColumn("mode", F.lit("multispectral"))


def visual_report(
    diff: DataFrame, cloud: DataFrame, drift: DataFrame, tile_keys: Sequence[str], measure: str = "embedding distance"
) -> DataFrame:
    """Three-band mode: difference, cloud and drift only; no index is claimed. `measure` says what drift was taken from."""
    keys = list(tile_keys)
    joined = difference_summary(diff, keys).join(cloud, keys).join(drift, keys, "left")
    return joined.select(
        *keys,
        F.lit("rgb_visual_only").alias("mode"),
        "mean_diff",
        "max_diff",
        F.concat(
            F.lit("Cloud/shadow change: "),
            F.format_number(F.round(F.col("cloud_t1") * 100, 1), 1),
            F.lit("% → "),
            F.format_number(F.round(F.col("cloud_t2") * 100, 1), 1),
            F.lit("%"),
        ).alias("atmosphere"),
        F.concat(
            F.lit("Overall visual dissimilarity: "), F.format_number("drift", 3), F.lit(f" ({measure})")
        ).alias("visual_dissimilarity"),
    )
