"""Queries for indices, differences, display scaling and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.operators import matching, spectral, tiling
from tilescope.plans.registry import Data, query, r6

SIZE = 16
RGB = ["b04", "b03", "b02"]
TILE = ["tile_row", "tile_col"]
PAIR_TILE = ["pair", *TILE]
MEASURES = [f"{n}_{s}" for n in ("ndvi", "ndbi", "ndwi") for s in ("t1", "t2", "change")]

INDEX_SQL = """
WITH ix AS (
  SELECT tile, t, scl, (b08 - b04) / (b08 + b04 + 1e-6) AS ndvi, (b11 - b08) / (b11 + b08 + 1e-6) AS ndbi,
    (b03 - b08) / (b03 + b08 + 1e-6) AS ndwi, b02, b03, b04, b08, b11 FROM pixels_ms
), means AS (
  SELECT tile, avg(ndvi) FILTER (WHERE t = 1) AS ndvi_t1, avg(ndvi) FILTER (WHERE t = 2) AS ndvi_t2,
    avg(ndbi) FILTER (WHERE t = 1) AS ndbi_t1, avg(ndbi) FILTER (WHERE t = 2) AS ndbi_t2,
    avg(ndwi) FILTER (WHERE t = 1) AS ndwi_t1, avg(ndwi) FILTER (WHERE t = 2) AS ndwi_t2,
    100 * avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1.0 ELSE 0 END) FILTER (WHERE t = 1) AS cloud_pct_t1,
    100 * avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1.0 ELSE 0 END) FILTER (WHERE t = 2) AS cloud_pct_t2
  FROM ix GROUP BY tile
)
"""


@query(
    "normalized_difference",
    INDEX_SQL
    + "SELECT tile, t, round(sum(ndvi), 4) AS ndvi, round(sum(ndbi), 4) AS ndbi, round(sum(ndwi), 4) AS ndwi FROM ix GROUP BY tile, t",
    ("pixels_ms",),
)
def normalized_difference(d: Data):
    sums = [F.round(F.sum(index), 4).alias(name) for name, index in spectral.indices().items()]
    return d.view("pixels_ms").groupBy("tile", "t").agg(*sums)


@query(
    "index_change",
    INDEX_SQL
    + """
SELECT tile, round(ndvi_t1, 6) AS ndvi_t1, round(ndvi_t2, 6) AS ndvi_t2, round(ndvi_t2 - ndvi_t1, 6) AS ndvi_change,
  round(ndbi_t1, 6) AS ndbi_t1, round(ndbi_t2, 6) AS ndbi_t2, round(ndbi_t2 - ndbi_t1, 6) AS ndbi_change,
  round(ndwi_t1, 6) AS ndwi_t1, round(ndwi_t2, 6) AS ndwi_t2, round(ndwi_t2 - ndwi_t1, 6) AS ndwi_change FROM means""",
    ("pixels_ms",),
)
def index_change(d: Data):
    return spectral.index_change(d.view("pixels_ms"), ["tile"]).select("tile", *[r6(m) for m in MEASURES])


def raster_diff(d: Data):
    """Difference of each scene and the next one pixel by pixel, with the tile of each pixel; `pair` is the first scene."""
    first, second = paired(d)
    return tiling.place_in_windows(spectral.pixel_difference(first, second, ["pair", "y", "x"], RGB), SIZE, SIZE)


def paired(d: Data):
    """Pixels as the first and as the second of every consecutive pair of scenes; a pair is named after its first."""
    return d.raster.withColumn("pair", F.col("scene_id")), d.raster.withColumn("pair", F.col("scene_id") - 1)


DIFF_SQL = """
WITH diff AS (
  SELECT a.scene_id AS pair, a.y, a.x, CAST(floor(a.y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(a.x / 16) AS BIGINT) * 16 AS tile_col,
    (abs(b.b04 - a.b04) + abs(b.b03 - a.b03) + abs(b.b02 - a.b02)) / 3 AS diff
  FROM raster a JOIN raster b ON a.y = b.y AND a.x = b.x AND b.scene_id = a.scene_id + 1
), per_tile AS (
  SELECT pair, tile_row, tile_col, avg(diff) AS mean_diff, max(diff) AS max_diff, quantile_cont(diff, 0.98) AS p98 FROM diff GROUP BY ALL
)
"""


@query(
    "hist_match_bands",
    """
WITH px AS (
  SELECT CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col, y, x, pair, side,
    unnest(['b04', 'b03', 'b02']) AS band, CAST(unnest([b04, b03, b02]) AS DOUBLE) AS v
  FROM (SELECT *, scene_id AS pair, 1 AS side FROM raster UNION ALL SELECT *, scene_id - 1 AS pair, 2 AS side FROM raster)
), tally AS (SELECT pair, tile_row, tile_col, band, side, v, count(*) AS n FROM px GROUP BY ALL
), curve AS (
  SELECT *, sum(n) OVER (PARTITION BY pair, tile_row, tile_col, band, side ORDER BY v) / sum(n) OVER (PARTITION BY pair, tile_row, tile_col, band, side) AS q FROM tally
), joined AS (
  SELECT s.pair, s.tile_row, s.tile_col, s.band, s.v, s.q, max(t.v) FILTER (WHERE t.q <= s.q) AS v0, max(t.q) FILTER (WHERE t.q <= s.q) AS q0,
    min(t.v) FILTER (WHERE t.q >= s.q) AS v1, min(t.q) FILTER (WHERE t.q >= s.q) AS q1
  FROM curve s JOIN curve t ON s.side = 2 AND t.side = 1 AND s.pair = t.pair AND s.tile_row = t.tile_row AND s.tile_col = t.tile_col AND s.band = t.band GROUP BY ALL
), mapped AS (
  SELECT *, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q1 = q0 THEN v0 ELSE v0 + (v1 - v0) * (q - q0) / (q1 - q0) END AS m FROM joined
)
SELECT pair, y, x, round(max(m) FILTER (WHERE band = 'b04'), 6) AS b04, round(max(m) FILTER (WHERE band = 'b03'), 6) AS b03,
  round(max(m) FILTER (WHERE band = 'b02'), 6) AS b02
FROM px JOIN mapped USING (pair, tile_row, tile_col, band, v) WHERE side = 2 GROUP BY pair, y, x""",
    ("raster",),
)
def hist_match_bands(d: Data):
    first, second = (tiling.place_in_windows(side, SIZE, SIZE) for side in paired(d))
    matched = matching.match_images(first, second, PAIR_TILE, RGB).filter("b04 IS NOT NULL")  # no first scene: no pair
    return matched.select("pair", "y", "x", *[r6(b) for b in RGB])


@query(
    "pixel_diff",
    DIFF_SQL
    + "SELECT pair, tile_row, tile_col, round(mean_diff, 9) AS mean_diff, round(max_diff, 6) AS max_diff, round(p98, 6) AS p98 FROM per_tile",
    ("raster",),
)
def pixel_diff(d: Data):
    return spectral.difference_summary(raster_diff(d), PAIR_TILE).select(*PAIR_TILE, F.round("mean_diff", 9).alias("mean_diff"), r6("max_diff"), r6("p98"))


@query(
    "pixel_diff_scaled",
    DIFF_SQL
    + """
SELECT pair, y, x, round(greatest(0, least(1, diff / (p98 + 1e-6))), 6) AS level FROM diff JOIN per_tile USING (pair, tile_row, tile_col)""",
    ("raster",),
)
def pixel_diff_scaled(d: Data):
    return spectral.difference_scaled(raster_diff(d), PAIR_TILE).select("pair", "y", "x", r6("level"))


@query(
    "percentile_stretch",
    """
WITH px AS (
  SELECT *, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col FROM raster
), cuts AS (
  SELECT scene_id, tile_row, tile_col, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (
    SELECT scene_id, tile_row, tile_col, CAST(unnest([b08, b04, b03]) AS DOUBLE) AS v FROM px) GROUP BY ALL
)
SELECT scene_id, y, x, CAST(floor(greatest(0, least(255, (b08 - lo) / greatest(hi - lo, 1e-6) * 255))) AS INT) AS b08,
  CAST(floor(greatest(0, least(255, (b04 - lo) / greatest(hi - lo, 1e-6) * 255))) AS INT) AS b04,
  CAST(floor(greatest(0, least(255, (b03 - lo) / greatest(hi - lo, 1e-6) * 255))) AS INT) AS b03
FROM px JOIN cuts USING (scene_id, tile_row, tile_col)""",
    ("raster",),
)
def percentile_stretch(d: Data):
    placed = tiling.place_in_windows(d.raster, SIZE, SIZE)
    shown = spectral.percentile_stretch(placed, tiling.TILE_KEYS, ["b08", "b04", "b03"])
    return shown.select("scene_id", "y", "x", "b08", "b04", "b03")


@query(
    "index_scale",
    INDEX_SQL
    + """
SELECT tile, round(avg(greatest(0, least(1, ndvi + 0.2))), 6) AS ndvi, round(avg(greatest(0, least(1, (ndbi + 0.4) / 0.8))), 6) AS ndbi,
  round(avg(greatest(0, least(1, (ndwi + 0.5) / 0.8))), 6) AS ndwi FROM ix GROUP BY tile""",
    ("pixels_ms",),
)
def index_scale(d: Data):
    levels = [r6(F.avg(spectral.index_scale(index, name)), name) for name, index in spectral.indices().items()]
    return d.view("pixels_ms").groupBy("tile").agg(*levels)


# DuckDB: sentences for changes rounded to four decimals.
NARRATIVE_SQL = """
, ch AS (
  SELECT tile, round(round(ndvi_t2, 4) - round(ndvi_t1, 4), 4) AS v, round(round(ndbi_t2, 4) - round(ndbi_t1, 4), 4) AS b,
    round(round(ndwi_t2, 4) - round(ndwi_t1, 4), 4) AS w, round(cloud_pct_t1, 1) AS c1, round(cloud_pct_t2, 1) AS c2 FROM means
), told AS (
  SELECT tile, v, b, w,
    CASE WHEN v < -0.1 THEN printf('Vegetation cover decreased by %.1f%% — consistent with clearance or construction activity.', abs(v) * 100)
      WHEN v > 0.1 THEN printf('Vegetation cover increased by %.1f%% — consistent with growth or seasonal regrowth.', v * 100)
      ELSE 'No significant vegetation change detected.' END AS vegetation,
    CASE WHEN b > 0.1 THEN printf('Built-up index increased by %.1f%% — consistent with new construction.', b * 100)
      WHEN b < -0.1 THEN printf('Built-up index decreased by %.1f%% — consistent with ground clearance or demolition.', abs(b) * 100)
      WHEN abs(b) >= 0.02 THEN printf('Built-up index %s slightly by %.1f%% — minor surface alteration observed.',
        CASE WHEN b > 0 THEN 'increased' ELSE 'decreased' END, abs(b) * 100)
      ELSE 'No significant infrastructure change detected.' END AS infrastructure,
    CASE WHEN w > 0.1 THEN printf('Water index increased by %.1f%% — consistent with surface inundation or expansion.', w * 100)
      WHEN w < -0.1 THEN printf('Water index decreased by %.1f%% — consistent with drainage or sediment accretion.', abs(w) * 100)
      WHEN abs(w) >= 0.02 THEN printf('Water index %s slightly by %.1f%% — subtle seasonal moisture shift.',
        CASE WHEN w > 0 THEN 'increased' ELSE 'decreased' END, abs(w) * 100)
      ELSE 'No significant water-extent change detected.' END AS water,
    printf('Cloud/shadow contamination: %.1f%% (T1) → %.1f%% (T2) — ', c1, c2) || CASE WHEN greatest(c1, c2) <= 20
      THEN 'both within acceptable clarity range.' ELSE 'elevated atmospheric contamination noted.' END AS atmosphere
  FROM ch
)
"""


@query(
    "change_narrative",
    INDEX_SQL + NARRATIVE_SQL + "SELECT tile, vegetation, infrastructure, water, atmosphere FROM told",
    ("pixels_ms",),
)
def change_narrative(d: Data):
    pixels = d.view("pixels_ms")
    change = spectral.index_change(pixels, ["tile"])
    rounded = change.withColumns(
        {f"{n}_change": F.round(f"{n}_t2", 4) - F.round(f"{n}_t1", 4) for n in ("ndvi", "ndbi", "ndwi")}
    )
    cloud = spectral.cloud_change(pixels, ["tile"]).withColumnRenamed("tile", "cloud_tile")
    told = spectral.change_narrative(rounded.join(cloud, F.col("tile").eqNullSafe(F.col("cloud_tile"))))
    return told.select("tile", "vegetation", "infrastructure", "water", "atmosphere")


REPORT_PIXELS = """
WITH px AS (
  SELECT (pair * 1000000 + CAST(floor(y / 16) AS BIGINT)) * 16 + CAST(floor(x / 16) AS BIGINT) AS tile, t, pair,
    y, x, b02, b03, b04, b08, b11, scl
  FROM (SELECT *, scene_id AS pair, 1 AS t FROM raster UNION ALL SELECT *, scene_id - 1 AS pair, 2 AS t FROM raster)
  WHERE pair BETWEEN 0 AND (SELECT max(scene_id) - 1 FROM raster)
), ix AS (
  SELECT tile, t, scl, (b08 - b04) / (b08 + b04 + 1e-6) AS ndvi, (b11 - b08) / (b11 + b08 + 1e-6) AS ndbi, (b03 - b08) / (b03 + b08 + 1e-6) AS ndwi FROM px
), diff AS (
  SELECT a.tile, avg((abs(b.b04 - a.b04) + abs(b.b03 - a.b03) + abs(b.b02 - a.b02)) / 3) AS mean_diff,
    max((abs(b.b04 - a.b04) + abs(b.b03 - a.b03) + abs(b.b02 - a.b02)) / 3) AS max_diff
  FROM px a JOIN px b ON a.pair = b.pair AND a.y = b.y AND a.x = b.x AND a.t = 1 AND b.t = 2 GROUP BY a.tile
), means AS (""" + INDEX_SQL.split("means AS (")[1]


@query(
    "spectral_report",
    REPORT_PIXELS
    + NARRATIVE_SQL
    + """
SELECT told.tile, 'multispectral' AS mode, round(v, 4) AS ndvi_change, round(b, 4) AS ndbi_change, round(w, 4) AS ndwi_change,
  round(mean_diff, 9) AS mean_diff, round(max_diff, 6) AS max_diff, vegetation, infrastructure, water, atmosphere
FROM told JOIN diff USING (tile)""",
    ("raster",),
)
def spectral_report(d: Data):
    tile = (F.col("pair") * 1000000 + F.floor(F.col("y") / SIZE)) * SIZE + F.floor(F.col("x") / SIZE)
    first, second = paired(d)
    pixels = first.withColumn("t", F.lit(1)).unionByName(second.withColumn("t", F.lit(2))).withColumn("tile", tile)
    diff = raster_diff(d).withColumn("tile", tile)
    report = spectral.spectral_report(pixels, diff, ["tile"])
    changes = [F.round(f"{n}_change", 4).alias(f"{n}_change") for n in ("ndvi", "ndbi", "ndwi")]
    return report.select(
        "tile", "mode", *changes, F.round("mean_diff", 9).alias("mean_diff"), r6("max_diff"), "vegetation", "infrastructure", "water", "atmosphere"
    )


@query(
    "visual_report",
    """
WITH px AS (
  SELECT *, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col FROM raster
), lit AS (
  SELECT scene_id, tile_row, tile_col, (b04 + b03 + b02) / 3 /
    CASE WHEN max(greatest(b04, b03, b02)) OVER (PARTITION BY scene_id, tile_row, tile_col) > 1 THEN 255.0 ELSE 1.0 END AS level FROM px
), cloud AS (
  SELECT scene_id, tile_row, tile_col, avg(CASE WHEN level >= 0.82 OR level <= 0.08 THEN 1.0 ELSE 0 END) AS c FROM lit GROUP BY ALL
), diff AS (
  SELECT a.scene_id AS pair, a.tile_row, a.tile_col, avg((abs(b.b04 - a.b04) + abs(b.b03 - a.b03) + abs(b.b02 - a.b02)) / 3) AS mean_diff,
    max((abs(b.b04 - a.b04) + abs(b.b03 - a.b03) + abs(b.b02 - a.b02)) / 3) AS max_diff
  FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND b.scene_id = a.scene_id + 1 GROUP BY ALL
)
SELECT pair, d.tile_row, d.tile_col, 'rgb_visual_only' AS mode, round(mean_diff, 9) AS mean_diff, round(max_diff, 6) AS max_diff,
  printf('Cloud/shadow change: %.1f%% → %.1f%%', round(e.c * 100, 1), round(f.c * 100, 1)) AS atmosphere,
  printf('Overall visual dissimilarity: %.3f (pixel difference)', mean_diff / 255) AS visual_dissimilarity
FROM diff d JOIN cloud e ON e.scene_id = d.pair AND e.tile_row = d.tile_row AND e.tile_col = d.tile_col
JOIN cloud f ON f.scene_id = d.pair + 1 AND f.tile_row = d.tile_row AND f.tile_col = d.tile_col""",
    ("raster",),
)
def visual_report(d: Data):
    diff = raster_diff(d)
    windows = tiling.tile_grid(d.raster, d.scenes, RGB, SIZE)
    # A scene is the first of its own pair and the second of the one before.
    sides = F.array(F.struct(F.col("scene_id").alias("pair"), F.lit(1).alias("t")), F.struct((F.col("scene_id") - 1).alias("pair"), F.lit(2).alias("t")))
    sided = windows.select(*TILE, "cloud_ratio", F.explode(sides).alias("s")).select(*TILE, "cloud_ratio", "s.*")
    cloud = sided.groupBy(*PAIR_TILE).agg(
        *[F.max(F.when(F.col("t") == t, F.col("cloud_ratio"))).alias(f"cloud_t{t}") for t in (1, 2)]
    )
    # No vectors of these windows, so their difference is told as a share of full scale, and named so.
    drift = spectral.difference_summary(diff, PAIR_TILE).select(*PAIR_TILE, (F.col("mean_diff") / 255).alias("drift"))
    report = spectral.visual_report(diff, cloud, drift, PAIR_TILE, measure="pixel difference")
    return report.select(*PAIR_TILE, "mode", F.round("mean_diff", 9).alias("mean_diff"), r6("max_diff"), "atmosphere", "visual_dissimilarity")
