"""Cutting rasters into tiles, reading windows and aligning bands.

A raster is a long table (scene_id, y, x, one column per band), so a scan reads
only the bands a query names. A scene table carries width, height, nodata, crs
and the affine transform as array(a, b, c, d, e, f).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions import geodesy, identity

TILE_KEYS = ["scene_id", "tile_row", "tile_col"]


def stride_of(size: int, overlap: int) -> int:
    return max(1, size - overlap)


def _offsets(position: Column, size: int, stride: int) -> Column:
    """Offsets of all windows along one axis that cover a position."""
    last = F.floor(position / stride)
    first = F.greatest(F.lit(0), F.floor((position - size) / stride) + 1)
    steps = F.sequence(F.least(first, last), last)
    return F.filter(F.transform(steps, lambda k: k * stride), lambda o: o + size > position)


def place_in_windows(df: DataFrame, size: int, stride: int, y: str = "y", x: str = "x") -> DataFrame:
    """Add tile_row / tile_col. Rows are copied only where windows overlap."""
    if stride == size:
        return df.withColumn("tile_row", F.floor(F.col(y) / size) * size).withColumn(
            "tile_col", F.floor(F.col(x) / size) * size
        )
    rows = df.withColumn("tile_row", F.explode(_offsets(F.col(y), size, stride)))
    return rows.withColumn("tile_col", F.explode(_offsets(F.col(x), size, stride)))


def tile_grid(
    pixels: DataFrame,
    scenes: DataFrame,
    bands: Sequence[str],
    size: int = config.TILE_SIZE,
    overlap: int = 0,
    black: float = config.BLACK_PIXEL_THRESHOLD,
    rules: config.QualityRules = config.QualityRules(),
    full_scale: float = 255.0,
) -> DataFrame:
    """One row per window with everything the quality filters need.

    Each axis is cut where a window starts or ends, so at most twice per stride,
    and pixels are first reduced to the blocks between cuts. Every window is a
    whole number of blocks; only block totals are copied into overlapping
    windows, never pixels. Ratios under both scalings (as stored, and divided by
    `full_scale`) are tallied in the same pass because the window maximum that selects
    between them is known only at the end.
    """
    stride = stride_of(size, overlap)

    def cut(position: str) -> Column:
        start = F.floor(F.col(position) / stride) * stride
        end = F.floor((F.col(position) - size) / stride) * stride + size
        return F.greatest(start, F.when(F.col(position) >= size, end))

    colour = [F.col(b).cast("double") for b in bands[:3]]

    facts = scenes.select("scene_id", "nodata", "width", "height")
    joined = pixels.join(facts, "scene_id")
    is_valid = F.lit(False)
    for b in bands:
        is_valid = is_valid | (F.col(b) != F.col("nodata"))
    is_valid = F.when(F.col("nodata").isNull(), F.lit(True)).otherwise(is_valid)

    def dark(divisor: float) -> Column:
        return sum((F.when(c / divisor <= black, 1).otherwise(0) for c in colour), F.lit(0))

    def murky(divisor: float) -> Column:
        unit = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / divisor)) for c in colour]
        grey = sum(unit[1:], unit[0]) / len(unit)
        return F.when((grey >= rules.cloud) | (grey <= rules.shadow), 1).otherwise(0)

    blocks = (
        joined.groupBy(
            "scene_id",
            "width",
            "height",
            cut("y").alias("by"),
            cut("x").alias("bx"),
        )
        .agg(
            F.count(F.lit(1)).alias("n_pixels"),
            F.count_if(is_valid).alias("n_valid"),
            F.max(F.greatest(*colour) if len(colour) > 1 else colour[0]).alias("max_value"),
            F.sum(dark(1.0)).alias("dark_raw"),
            F.sum(dark(full_scale)).alias("dark_scaled"),
            F.sum(murky(1.0)).alias("murky_raw"),
            F.sum(murky(full_scale)).alias("murky_scaled"),
        )
    )
    return windows_of_cells(blocks, size, stride, len(colour), whole=stride == size)


def windows_of_cells(cells: DataFrame, size: int, stride: int, n_colours: int, whole: bool) -> DataFrame:
    """Windows with their ratios from the totals of cells at (by, bx); `whole` if a cell is a window."""
    counts = ["n_pixels", "n_valid", "dark_raw", "dark_scaled", "murky_raw", "murky_scaled"]
    placed = place_in_windows(cells, size, stride, "by", "bx")
    if whole:
        windows = placed.drop("by", "bx")
    else:
        windows = placed.groupBy(*TILE_KEYS, "width", "height").agg(
            *[F.sum(c).alias(c) for c in counts], F.max("max_value").alias("max_value")
        )
    needs_scale = F.col("max_value") > 1.0
    n = F.col("n_pixels")
    return windows.select(
        *TILE_KEYS,
        "width",
        "height",
        "n_pixels",
        "max_value",
        (F.col("n_valid") / n).alias("valid_ratio"),
        (F.when(needs_scale, F.col("dark_scaled")).otherwise(F.col("dark_raw")) / (n * n_colours)).alias("dark_ratio"),
        (F.when(needs_scale, F.col("murky_scaled")).otherwise(F.col("murky_raw")) / n).alias("cloud_ratio"),
    )


def drop_ragged(tiles: DataFrame, size: int = config.TILE_SIZE) -> DataFrame:
    """Drop windows that stick out at the right or bottom edge."""
    return tiles.filter(
        (F.col("tile_row") + size <= F.col("height")) & (F.col("tile_col") + size <= F.col("width"))
    )


def drop_nodata(tiles: DataFrame, min_valid: float = config.MIN_VALID_PIXEL_RATIO) -> DataFrame:
    return tiles.filter(F.col("valid_ratio") >= min_valid)


def drop_black(tiles: DataFrame, min_valid: float = config.MIN_VALID_PIXEL_RATIO) -> DataFrame:
    return tiles.filter(F.col("dark_ratio") <= 1.0 - min_valid)


def describe_tiles(tiles: DataFrame, scenes: DataFrame, size: int = config.TILE_SIZE) -> DataFrame:
    """Attach identity, geometry and scene attributes to grid rows."""
    facts = scenes.select("scene_id", "stem", "date", "sensor", "crs", "affine")
    placed = tiles.join(facts, "scene_id")
    bounds = geodesy.window_bounds(F.col("tile_row"), F.col("tile_col"), size, F.col("affine"))
    name = identity.tile_identity(F.col("stem"), F.col("tile_row"), F.col("tile_col"), F.col("date"))
    return (
        placed.withColumn("tile_id", name)
        .withColumn("point_id", identity.point_id(F.col("tile_id")))
        .withColumn("bbox", geodesy.bbox(bounds, F.col("crs")))
        .drop("affine")
    )


def ingest_tiles(
    pixels: DataFrame, scenes: DataFrame, bands: Sequence[str], size: int = config.TILE_SIZE, overlap: int = 0
) -> DataFrame:
    """Grid, filter and describe the tiles of a set of scenes."""
    grid = tile_grid(pixels, scenes, bands, size, overlap)
    return describe_tiles(drop_black(drop_nodata(drop_ragged(grid, size))), scenes, size)


def window_read(pixels: DataFrame, requests: DataFrame, size: int = config.TILE_SIZE) -> DataFrame:
    """Pixels of the requested windows (scene_id, tile_row, tile_col).

    A window overlaps at most four cells of a size-aligned grid, so requests are
    matched by cell equality and trimmed by range.
    """
    cells = requests.withColumn(
        "__cy", F.explode(F.sequence(F.floor(F.col("tile_row") / size), F.floor((F.col("tile_row") + size - 1) / size)))
    ).withColumn(
        "__cx", F.explode(F.sequence(F.floor(F.col("tile_col") / size), F.floor((F.col("tile_col") + size - 1) / size)))
    )
    keyed = pixels.withColumn("__cy", F.floor(F.col("y") / size)).withColumn("__cx", F.floor(F.col("x") / size))
    inside = (
        (F.col("y") >= F.col("tile_row"))
        & (F.col("y") < F.col("tile_row") + size)
        & (F.col("x") >= F.col("tile_col"))
        & (F.col("x") < F.col("tile_col") + size)
    )
    return keyed.join(cells, ["scene_id", "__cy", "__cx"]).filter(inside).drop("__cy", "__cx")


def aoi_windows(scenes: DataFrame, center_x: Column, center_y: Column, size: int) -> DataFrame:
    """Window of `size` pixels centred on a point (scene CRS), kept inside each scene."""
    a, c, e, f = (F.col("affine")[i] for i in (0, 2, 4, 5))
    row, col = F.floor((center_y - f) / e), F.floor((center_x - c) / a)
    half = size // 2

    def clamp(centre: Column, extent: Column) -> Column:
        return F.greatest(F.lit(0), F.least(centre - half, extent - size))

    return scenes.withColumn("row_off", clamp(row, F.col("height"))).withColumn("col_off", clamp(col, F.col("width")))


def aoi_clip(pixels: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Pixels inside each scene's window, renumbered from its corner."""
    offsets = windows.select("scene_id", "row_off", "col_off")
    row, col = F.col("y") - F.col("row_off"), F.col("x") - F.col("col_off")
    inside = (row >= 0) & (row < size) & (col >= 0) & (col < size)
    kept = pixels.join(offsets, "scene_id").filter(inside)
    return kept.withColumn("y", row).withColumn("x", col).drop("row_off", "col_off")


def band_stack(
    fine: DataFrame,
    coarse: DataFrame,
    fine_bands: Sequence[str],
    class_bands: Sequence[str],
    smooth_bands: Sequence[str],
    factor: int = 2,
) -> DataFrame:
    """Bring coarse bands onto the fine grid and stack all bands per pixel.

    Each coarse pixel is spread over the fine pixels it weighs on (bilinear for
    measurements, nearest for classes) and everything meets in one aggregation,
    so there is a single shuffle. Dividing by the sum of weights extends edge
    values outward.
    """
    reach = F.sequence(F.lit(-(factor // 2) - 1), F.lit(factor + factor // 2))
    spread = (
        coarse.withColumn("__dy", F.explode(reach))
        .withColumn("__dx", F.explode(reach))
        .withColumn("__y", F.col("y") * factor + F.col("__dy"))
        .withColumn("__x", F.col("x") * factor + F.col("__dx"))
    )

    def tent(fine_pos: Column, coarse_pos: Column) -> Column:
        return F.lit(1.0) - F.abs((fine_pos + 0.5) / factor - 0.5 - coarse_pos)

    wy, wx = tent(F.col("__y"), F.col("y")), tent(F.col("__x"), F.col("x"))
    own = F.col("__dy").between(0, factor - 1) & F.col("__dx").between(0, factor - 1)
    weighed = spread.withColumn("__w", F.greatest(wy, F.lit(0.0)) * F.greatest(wx, F.lit(0.0))).filter(
        (F.col("__w") > 0) & (F.col("__y") >= 0) & (F.col("__x") >= 0)
    )
    contributions = weighed.select(
        "scene_id",
        F.col("__y").alias("y"),
        F.col("__x").alias("x"),
        "__w",
        *[(F.col(b) * F.col("__w")).alias(b) for b in smooth_bands],
        *[F.when(own, F.col(b)).alias(b) for b in class_bands],
        F.lit(False).alias("__fine"),
    )
    base = fine.select("scene_id", "y", "x", *fine_bands, F.lit(True).alias("__fine"))
    together = base.unionByName(contributions, allowMissingColumns=True)
    return (
        together.groupBy("scene_id", "y", "x")
        .agg(
            F.max("__fine").alias("__fine"),
            *[F.max(b).alias(b) for b in fine_bands],
            *[(F.sum(b) / F.sum("__w")).alias(b) for b in smooth_bands],
            *[F.max(b).alias(b) for b in class_bands],
        )
        .filter("__fine")
        .drop("__fine")
    )


def pair_readiness(scenes: DataFrame) -> DataFrame:
    """Scenes of a site, each compared with the next one by id, in CRS, size and transform."""
    carried = ("scene_id", "crs", "width", "height", "affine")
    after = Window.partitionBy("site").orderBy("scene_id")
    pairs = scenes.select(
        *[F.col(c).alias(f"{c}_a") for c in carried], *[F.lead(c).over(after).alias(f"{c}_b") for c in carried]
    ).filter("scene_id_b IS NOT NULL")
    same_crs = F.col("crs_a").eqNullSafe(F.col("crs_b"))
    same_size = (F.col("width_a") == F.col("width_b")) & (F.col("height_a") == F.col("height_b"))
    same_grid = F.col("affine_a") == F.col("affine_b")
    return pairs.select(
        "scene_id_a",
        "scene_id_b",
        same_crs.alias("same_crs"),
        same_size.alias("same_size"),
        same_grid.alias("same_transform"),
        (same_crs & same_size & same_grid).alias("ready"),
    )
