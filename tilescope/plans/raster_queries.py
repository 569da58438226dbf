"""Queries over rasters, scenes and tile points."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilescope.functions import identity, vectors
from tilescope.operators import blocks, catalog, embedding, ledger, overlap, quality, search, tiling, warp
from tilescope.plans.registry import REGISTRY, Data, query, r6
from tilescope.session import shared_folder
from tilescope.sources.raster_source import NpyStrips, RasterWindows

RGB = ["b04", "b03", "b02"]
GRID_BANDS = ["b04", "b03", "b02", "b08"]
SIZE = 16


def grid(d: Data, overlap: int = 0):
    return tiling.tile_grid(d.raster, d.scenes, GRID_BANDS, SIZE, overlap)


# One row per 16-px window with its quality measures; `w` must give pixel rows
# with tile_row and tile_col.
WINDOW_STATS = """
, peaks AS (
  SELECT scene_id, tile_row, tile_col, max(greatest(b04, b03, b02)) AS peak FROM w GROUP BY ALL
), scaled AS (
  SELECT w.*, CASE WHEN peak > 1 THEN 255.0 ELSE 1.0 END AS divisor, peak
  FROM w JOIN peaks USING (scene_id, tile_row, tile_col)
), grid AS (
  SELECT scene_id, tile_row, tile_col, width, height, count(*) AS n_pixels, CAST(max(peak) AS DOUBLE) AS max_value,
    avg(CASE WHEN nodata IS NULL OR b04 <> nodata OR b03 <> nodata OR b02 <> nodata OR b08 <> nodata THEN 1.0 ELSE 0.0 END) AS valid_ratio,
    avg((CASE WHEN b04 / divisor <= 0.02 THEN 1.0 ELSE 0.0 END + CASE WHEN b03 / divisor <= 0.02 THEN 1.0 ELSE 0.0 END
       + CASE WHEN b02 / divisor <= 0.02 THEN 1.0 ELSE 0.0 END) / 3) AS dark_ratio,
    avg(CASE WHEN (b04 / divisor + b03 / divisor + b02 / divisor) / 3 >= 0.82
              OR (b04 / divisor + b03 / divisor + b02 / divisor) / 3 <= 0.08 THEN 1.0 ELSE 0.0 END) AS cloud_ratio
  FROM scaled GROUP BY scene_id, tile_row, tile_col, width, height
)
"""
PLAIN_WINDOWS = """
WITH w AS (
  SELECT r.*, s.width, s.height, s.nodata,
         CAST(floor(r.y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(r.x / 16) AS BIGINT) * 16 AS tile_col
  FROM raster r JOIN scenes s ON r.scene_id = s.scene_id
)
""" + WINDOW_STATS

GRID_COLUMNS = """SELECT scene_id, tile_row, tile_col, n_pixels, round(valid_ratio, 9) AS valid_ratio,
  round(dark_ratio, 9) AS dark_ratio, round(cloud_ratio, 9) AS cloud_ratio FROM grid"""


def shown(tiles):
    # Nine decimals: shares of 256 pixels have up to eight.
    ratios = [F.round(c, 9).alias(c) for c in ("valid_ratio", "dark_ratio", "cloud_ratio")]
    return tiles.select("scene_id", "tile_row", "tile_col", "n_pixels", *ratios)


@query(
    "tile_grid",
    """
WITH w1 AS (
  SELECT r.*, s.width, s.height, s.nodata, unnest([o for o in range(0, r.y + 1, 8) if o + 16 > r.y]) AS tile_row
  FROM raster r JOIN scenes s ON r.scene_id = s.scene_id
), w AS (SELECT *, unnest([o for o in range(0, x + 1, 8) if o + 16 > x]) AS tile_col FROM w1)
"""
    + WINDOW_STATS
    + GRID_COLUMNS,
    ("raster", "scenes"),
)
def tile_grid(d: Data):
    return shown(grid(d, overlap=8))


@query(
    "tile_drop_ragged",
    PLAIN_WINDOWS + GRID_COLUMNS + " WHERE tile_row + 16 <= height AND tile_col + 16 <= width",
    ("raster", "scenes"),
)
def tile_drop_ragged(d: Data):
    return shown(tiling.drop_ragged(grid(d), SIZE))


@query("tile_nodata_filter", PLAIN_WINDOWS + GRID_COLUMNS + " WHERE valid_ratio >= 0.85", ("raster", "scenes"))
def tile_nodata_filter(d: Data):
    return shown(tiling.drop_nodata(grid(d)))


@query("tile_black_filter", PLAIN_WINDOWS + GRID_COLUMNS + " WHERE dark_ratio <= 1 - 0.85", ("raster", "scenes"))
def tile_black_filter(d: Data):
    return shown(tiling.drop_black(grid(d)))


@query(
    "tile_bbox",
    """
WITH g AS (
  SELECT DISTINCT scene_id, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col FROM raster
), b AS (
  SELECT g.*, s.crs, aff_c + 10 * tile_col AS l, aff_f - 10 * tile_row AS t, s.width, s.height
  FROM g JOIN scenes s USING (scene_id) WHERE tile_row + 16 <= height AND tile_col + 16 <= width
)
SELECT scene_id, tile_row, tile_col, crs, 'Polygon' AS geometry, l AS left_x, t - 160 AS bottom_y, l + 160 AS right_x, t AS top_y,
  concat_ws(';', concat_ws(',', CAST(l + 160 AS BIGINT), CAST(t - 160 AS BIGINT)), concat_ws(',', CAST(l + 160 AS BIGINT), CAST(t AS BIGINT)),
    concat_ws(',', CAST(l AS BIGINT), CAST(t AS BIGINT)), concat_ws(',', CAST(l AS BIGINT), CAST(t - 160 AS BIGINT)),
    concat_ws(',', CAST(l + 160 AS BIGINT), CAST(t - 160 AS BIGINT))) AS ring
FROM b""",
    ("raster", "scenes"),
)
def tile_bbox(d: Data):
    described = tiling.describe_tiles(tiling.drop_ragged(grid(d), SIZE), d.scenes, SIZE)
    corner = lambda p: F.concat_ws(",", F.transform(p, lambda v: v.cast("long").cast("string")))
    ring = F.concat_ws(";", F.transform(F.col("bbox.coordinates")[0], corner))
    bounds = [F.col("bbox.bounds")[i].alias(n) for i, n in enumerate(("left_x", "bottom_y", "right_x", "top_y"))]
    return described.select(
        "scene_id", "tile_row", "tile_col", "crs", F.col("bbox.type").alias("geometry"), *bounds, ring.alias("ring")
    )


@query(
    "tile_identity",
    """
SELECT DISTINCT scene_id, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col,
  stem || '_r' || CAST(floor(y / 16) AS BIGINT) * 16 || '_c' || CAST(floor(x / 16) AS BIGINT) * 16 || '_' || date AS tile_id
FROM raster JOIN scenes USING (scene_id)""",
    ("raster", "scenes"),
)
def tile_identity(d: Data):
    windows = tiling.place_in_windows(d.raster, SIZE, SIZE).select(*tiling.TILE_KEYS).distinct()
    return tiling.describe_tiles(windows, d.scenes, SIZE).select(*tiling.TILE_KEYS, "tile_id")


@query(
    "point_id",
    """
WITH h AS (
  SELECT vec_id, tile_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(tile_id)) AS h FROM tiles
)
SELECT vec_id, tile_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
  CASE WHEN h[17:17] IN ('0','4','8','c') THEN '8' WHEN h[17:17] IN ('1','5','9','d') THEN '9'
       WHEN h[17:17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS point_id
FROM h""",
    ("tiles",),
)
def point_id(d: Data):
    return d.tiles.select("vec_id", "tile_id", identity.point_id(F.col("tile_id")).alias("point_id"))


@query(
    "window_read",
    """
SELECT scene_id, y, x, b02, b03, b04, b08, b11, scl FROM raster
WHERE y >= 8 AND y < 24 AND x >= 20 AND x < 36""",
    ("raster",),
)
def window_read(d: Data):
    asked = d.scenes.select("scene_id", F.lit(8).cast("long").alias("tile_row"), F.lit(20).cast("long").alias("tile_col"))
    return tiling.window_read(d.raster, asked, SIZE).drop("tile_row", "tile_col")


@query(
    "embed_tiles",
    """
WITH px AS (
  SELECT scene_id, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col, b04, b03, b02
  FROM raster
), v AS (
  SELECT scene_id, tile_row, tile_col, unnest([b04, b03, b02]) AS v FROM px
), bins AS (
  SELECT scene_id, tile_row, tile_col, avg(CASE WHEN v < 64 THEN 1.0 ELSE 0 END) AS h0,
    avg(CASE WHEN v >= 64 AND v < 128 THEN 1.0 ELSE 0 END) AS h1, avg(CASE WHEN v >= 128 AND v < 192 THEN 1.0 ELSE 0 END) AS h2,
    avg(CASE WHEN v >= 192 THEN 1.0 ELSE 0 END) AS h3 FROM v GROUP BY ALL
), means AS (
  SELECT scene_id, tile_row, tile_col, avg(b04) / 256 AS m0, avg(b03) / 256 AS m1, avg(b02) / 256 AS m2 FROM px GROUP BY ALL
), e AS (
  SELECT *, sqrt(m0*m0 + m1*m1 + m2*m2 + h0*h0 + h1*h1 + h2*h2 + h3*h3) AS len FROM means JOIN bins USING (scene_id, tile_row, tile_col)
)
SELECT scene_id, tile_row, tile_col, round(m0 / len, 6) AS e0, round(m1 / len, 6) AS e1, round(m2 / len, 6) AS e2,
  round(h0 / len, 6) AS e3, round(h1 / len, 6) AS e4, round(h2 / len, 6) AS e5, round(h3 / len, 6) AS e6 FROM e""",
    ("raster",),
)
def embed_tiles(d: Data):
    placed = tiling.place_in_windows(d.raster, SIZE, SIZE)
    chips = embedding.tile_chips(placed, tiling.TILE_KEYS, RGB)
    embedded = embedding.embed_tiles(chips, embedding.BandHistogramEmbedder(3, bins=4))
    return embedded.select(*tiling.TILE_KEYS, *[r6(F.col("embedding")[i], f"e{i}") for i in range(7)])


@query(
    "embed_text",
    """
WITH c AS (
  SELECT doc_id, i - 1 AS dim, len(text) - len(replace(replace(text, chr(96 + i), ''), chr(64 + i), '')) AS n
  FROM documents, (SELECT unnest(range(1, 27))::INT AS i)
), l AS (SELECT doc_id, greatest(sqrt(sum(n * n)), 1e-12) AS len FROM c GROUP BY doc_id)
SELECT doc_id, dim, round(n / len, 6) AS value FROM c JOIN l USING (doc_id)""",
)
def embed_text(d: Data):
    texts = d.table("documents").select("doc_id", "text")
    embedded = embedding.embed_text(texts, embedding.LetterCountEmbedder())
    return embedded.select("doc_id", F.posexplode("embedding").alias("dim", "v")).select("doc_id", "dim", r6("v", "value"))


FEED = """
SELECT replace(point_id, '-2', '-1') AS point_id, tile_id, date, concat(sensor, ' new') AS sensor, version FROM {points} WHERE version = 2
UNION ALL
SELECT concat(point_id, 'x') AS point_id, tile_id, date, sensor, version FROM {points} WHERE label = 3
UNION ALL
SELECT replace(point_id, '-2', '-1') AS point_id, tile_id, date, 'latest' AS sensor, 3 AS version FROM {points} WHERE version = 2 AND label < 5
"""


@query(
    "vector_upsert",
    f"""
WITH feed AS ({FEED.format(points="points")}), both_ AS (
  SELECT point_id, tile_id, date, sensor, version FROM points UNION ALL SELECT * FROM feed
)
SELECT point_id, tile_id, date, sensor, version FROM both_
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY version DESC) = 1""",
    ("points",),
)
def vector_upsert(d: Data):
    stored = d.points.select("point_id", "tile_id", "date", "sensor", "version")
    return ledger.vector_upsert(stored, d.sql(FEED, "points"))


@query(
    "scroll_payload",
    "SELECT point_id, tile_id, cell, label FROM points WHERE date = '2023-12-08' AND sensor = 'Sentinel-2' ORDER BY point_id LIMIT 20",
    ("points",),
)
def scroll_payload(d: Data):
    found = search.scroll_payload(d.points, {"date": "2023-12-08", "sensor": "Sentinel-2"}, 20)
    return found.select("point_id", "tile_id", "cell", "label")


@query(
    "lookup_tile",
    "SELECT point_id, tile_id, date, sensor FROM points WHERE tile_id = 'aoi_2024-12-17_r0_c512_2024-12-17' ORDER BY point_id LIMIT 1",
    ("points",),
)
def lookup_tile(d: Data):
    return search.lookup_tile(d.points, "aoi_2024-12-17_r0_c512_2024-12-17").select("point_id", "tile_id", "date", "sensor")


@query(
    "scene_catalogue_search",
    """
SELECT scene_id, date, round(cloud_cover, 6) AS cloud_cover FROM catalogue
WHERE left_x <= 40 AND right_x >= 10 AND bottom_y <= 40 AND top_y >= 10 AND date BETWEEN '1995-01-01' AND '1997-12-31' AND cloud_cover < 10
ORDER BY date DESC, scene_id LIMIT 10""",
    ("catalogue",),
)
def scene_catalogue_search(d: Data):
    items = d.view("catalogue").withColumn("bounds", F.array("left_x", "bottom_y", "right_x", "top_y"))
    found = catalog.scene_catalogue_search(items, (10.0, 10.0, 40.0, 40.0), "1995-01-01", "1997-12-31")
    return found.select("scene_id", "date", r6("cloud_cover"))


@query(
    "aoi_clip",
    """
WITH c AS (
  SELECT scene_id, greatest(0, least(CAST(floor((2112820 - aff_f) / aff_e) AS BIGINT) - 10, height - 20)) AS r0,
         greatest(0, least(CAST(floor((274600 - aff_c) / aff_a) AS BIGINT) - 10, width - 20)) AS c0 FROM scenes
)
SELECT scene_id, y - r0 AS y, x - c0 AS x, b02, b03, b04 FROM raster JOIN c USING (scene_id)
WHERE y >= r0 AND y < r0 + 20 AND x >= c0 AND x < c0 + 20""",
    ("raster", "scenes"),
)
def aoi_clip(d: Data):
    windows = tiling.aoi_windows(d.scenes, F.lit(274600.0), F.lit(2112820.0), 20)
    return tiling.aoi_clip(d.raster, windows, 20).select("scene_id", "y", "x", "b02", "b03", "b04")


@query(
    "band_stack",
    """
WITH coarse AS (
  SELECT scene_id, y // 2 AS cy, x // 2 AS cx, b11, scl FROM raster WHERE y % 2 = 0 AND x % 2 = 0
), spots AS (
  SELECT scene_id, y, x, b02, b03, b04, b08, CAST(floor((y + 0.5) / 2 - 0.5) AS BIGINT) AS y0, CAST(floor((x + 0.5) / 2 - 0.5) AS BIGINT) AS x0,
    (y + 0.5) / 2 - 0.5 - floor((y + 0.5) / 2 - 0.5) AS fy, (x + 0.5) / 2 - 0.5 - floor((x + 0.5) / 2 - 0.5) AS fx FROM raster
), corners AS (
  SELECT s.scene_id, s.y, s.x, s.y0 + dy AS cy, s.x0 + dx AS cx,
    (CASE WHEN dy = 0 THEN 1 - fy ELSE fy END) * (CASE WHEN dx = 0 THEN 1 - fx ELSE fx END) AS w
  FROM spots s, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)
), smooth AS (
  SELECT c.scene_id, c.y, c.x, sum(w * b11) / sum(w) AS b11 FROM corners c JOIN coarse k
    ON c.scene_id = k.scene_id AND c.cy = k.cy AND c.cx = k.cx GROUP BY ALL
)
SELECT s.scene_id, s.y, s.x, s.b02, s.b03, s.b04, s.b08, round(m.b11, 6) AS b11, k.scl
FROM spots s LEFT JOIN smooth m ON s.scene_id = m.scene_id AND s.y = m.y AND s.x = m.x
LEFT JOIN coarse k ON s.scene_id = k.scene_id AND k.cy = s.y // 2 AND k.cx = s.x // 2""",
    ("raster",),
)
def band_stack(d: Data):
    fine = d.raster.drop("b11", "scl")
    coarse = d.raster.filter((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).select(
        "scene_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "b11", "scl"
    )
    stacked = tiling.band_stack(fine, coarse, ["b02", "b03", "b04", "b08"], ["scl"], ["b11"])
    return stacked.withColumn("b11", F.round("b11", 6))


@query(
    "pair_readiness",
    """
SELECT a.scene_id AS scene_id_a, b.scene_id AS scene_id_b, a.crs = b.crs AS same_crs,
  a.width = b.width AND a.height = b.height AS same_size,
  [a.aff_a, a.aff_b, a.aff_c, a.aff_d, a.aff_e, a.aff_f] = [b.aff_a, b.aff_b, b.aff_c, b.aff_d, b.aff_e, b.aff_f] AS same_transform,
  a.crs = b.crs AND a.width = b.width AND a.height = b.height AND a.aff_f = b.aff_f AS ready
FROM scenes a JOIN scenes b ON a.site = b.site AND b.scene_id = (SELECT min(c.scene_id) FROM scenes c WHERE c.site = a.site AND c.scene_id > a.scene_id)""",
    ("scenes",),
)
def pair_readiness(d: Data):
    return tiling.pair_readiness(d.scenes)


# -- pixel scaling and quality -------------------------------------------------


def tiled(d: Data):
    return tiling.place_in_windows(d.raster, SIZE, SIZE)


TILED = """
WITH px AS (
  SELECT *, CAST(floor(y / 16) AS BIGINT) * 16 AS tile_row, CAST(floor(x / 16) AS BIGINT) * 16 AS tile_col FROM raster
), unit AS (
  SELECT scene_id, tile_row, tile_col, y, x, b04 / d AS b04, b03 / d AS b03, b02 / d AS b02, scl FROM (
    SELECT *, CASE WHEN max(greatest(b04, b03, b02)) OVER (PARTITION BY scene_id, tile_row, tile_col) > 1 THEN 255.0 ELSE 1.0 END AS d FROM px)
)
"""


@query(
    "to_unit",
    TILED + "SELECT scene_id, y, x, round(b04, 6) AS b04, round(b03, 6) AS b03, round(b02, 6) AS b02 FROM unit",
    ("raster",),
)
def to_unit(d: Data):
    scaled = quality.to_unit(tiled(d), tiling.TILE_KEYS, RGB)
    return scaled.select("scene_id", "y", "x", *[r6(b) for b in RGB])


@query("grey", TILED + "SELECT scene_id, y, x, round((b04 + b03 + b02) / 3, 6) AS grey FROM unit", ("raster",))
def grey(d: Data):
    scaled = quality.to_unit(tiled(d), tiling.TILE_KEYS, RGB)
    return scaled.select("scene_id", "y", "x", r6(quality.grey(RGB), "grey"))


@query(
    "cloud_ratio",
    """
SELECT tile_id, round(avg(CASE WHEN level >= 0.82 OR level <= 0.08 THEN 1.0 ELSE 0.0 END), 6) AS cloud_ratio
FROM pixels_grey GROUP BY tile_id""",
    ("pixels_grey",),
)
def cloud_ratio(d: Data):
    ratios = quality.cloud_ratio(d.view("pixels_grey"), ["tile_id"], F.col("level"))
    return ratios.select("tile_id", r6("cloud_ratio"))


@query(
    "scl_cloud_ratio",
    """
SELECT tile, t, round(avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1.0 ELSE 0.0 END), 6) AS cloud_ratio FROM pixels_ms GROUP BY tile, t""",
    ("pixels_ms",),
)
def scl_cloud_ratio(d: Data):
    ratios = quality.scl_cloud_ratio(d.view("pixels_ms"), ["tile", "t"])
    return ratios.select("tile", "t", r6("cloud_ratio"))


@query(
    "unit_vector",
    """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 3)) /
  greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 3 * CAST(v AS DOUBLE) * 3))), 1e-12), 6) AS unit_sum FROM embeddings""",
)
def unit_vector(d: Data):
    scaled = F.transform("embedding", lambda v: v.cast("double") * 3)
    total = F.aggregate(vectors.unit(scaled), F.lit(0.0), lambda a, v: a + v)
    return d.table("embeddings").select("vec_id", r6(total, "unit_sum"))


# The same from packed blocks, and from raster files through the window source.
BLOCK = 16


def packed(d: Data, bands: list[str]):
    path = f"{shared_folder(d.spark).rstrip('/')}/blocks/{uuid.uuid4().hex}"
    blocks.write_blocks(blocks.pack_blocks(d.raster, bands, BLOCK), path)
    return d.spark.read.parquet(path)


@query("tile_grid_blocks", REGISTRY["tile_grid"].sql)
def tile_grid_blocks(d: Data):
    return shown(blocks.grid_of_blocks(packed(d, GRID_BANDS), d.scenes, GRID_BANDS, BLOCK, SIZE, overlap=8))


@query("window_read_blocks", REGISTRY["window_read"].sql)
def window_read_blocks(d: Data):
    bands = ["b02", "b03", "b04", "b08", "b11", "scl"]
    found = blocks.window_of_blocks(packed(d, bands), 8, 20, bands, BLOCK, SIZE)
    return found.select("scene_id", "y", "x", *[F.col(b).cast("long").alias(b) for b in bands])


@query("embed_tiles_blocks", REGISTRY["embed_tiles"].sql)
def embed_tiles_blocks(d: Data):
    chips = blocks.chips_of_blocks(packed(d, RGB), RGB, BLOCK, SIZE)
    embedded = embedding.embed_tiles(chips, embedding.BandHistogramEmbedder(3, bins=4))
    return embedded.select(*tiling.TILE_KEYS, *[r6(F.col("embedding")[i], f"e{i}") for i in range(7)])


def raster_files(d: Data, folder: str) -> None:
    """The raster as files of 64 rows each, written by tasks of one strip."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        scene, strip, width, date = (int(key[0]), int(key[1]), int(key[2]), key[3])
        values = np.full((len(GRID_BANDS), int(rows["y"].max()) - 64 * strip + 1, width), np.nan)
        values[:, rows["y"] - 64 * strip, rows["x"]] = rows[GRID_BANDS].to_numpy().T
        NpyStrips.write(folder, scene, date, 64 * strip, GRID_BANDS, values)
        return pd.DataFrame({"scene_id": [scene]})

    facts = d.scenes.select("scene_id", F.col("width").cast("long").alias("width"), F.col("date").cast("string").alias("date"))
    rows = d.raster.join(facts, "scene_id").withColumn("strip", F.floor(F.col("y") / 64).cast("long"))
    rows.groupBy("scene_id", "strip", "width", "date").applyInPandas(write, "scene_id long").write.format("noop").mode("overwrite").save()


@query("tile_grid_files", PLAIN_WINDOWS + GRID_COLUMNS, ("raster", "scenes"))
def tile_grid_files(d: Data):
    folder = f"{shared_folder(d.spark).rstrip('/')}/rasters/{uuid.uuid4().hex}".removeprefix("file:")
    raster_files(d, folder)
    windows = windows_in(d.spark, folder, BLOCK)
    return shown(blocks.grid_of_blocks(windows, d.scenes, GRID_BANDS, BLOCK, SIZE))


def windows_in(spark, folder: str, size: int):
    spark.dataSource.register(RasterWindows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raster_windows").option("folder", folder).option("size", size)
    return reader.option("decoder", "tilescope.sources.raster_source:NpyStrips").load()


# A grid turned by 3-4-5 and finer by 2.5 that covers its whole scene: target pixel (x, y) lies at source column
# 0.32 x + 0.24 y - 0.48 height and source row -0.24 x + 0.32 y + 0.36 height.
TURNED = """
SELECT scene_id, {a} * 0.32e0 - {b} * 0.24e0 AS ta, {a} * 0.24e0 + {b} * 0.32e0 AS tb, {b} * (0.36e0 * height) - {a} * (0.48e0 * height) + {c} AS tc,
  {d} * 0.32e0 - {e} * 0.24e0 AS td, {d} * 0.24e0 + {e} * 0.32e0 AS te, {e} * (0.36e0 * height) - {d} * (0.48e0 * height) + {f} AS tf,
  {a} AS sa, {b} AS sb, {c} AS sc, {d} AS sd, {e} AS se, {f} AS sf,
  CAST(ceil(2.5e0 * (0.8e0 * width + 0.6e0 * height)) AS BIGINT) AS tw, CAST(ceil(2.5e0 * (0.6e0 * width + 0.8e0 * height)) AS BIGINT) AS th
FROM {scenes}
"""
AFFINE = {k: f"CAST(aff_{k} AS DOUBLE)" for k in "abcdef"}


@query(
    "band_warp",
    f"""
WITH g AS ({TURNED.format(scenes="scenes", **AFFINE)}), m AS (
  SELECT *, (se * ta - sb * td) / (sa * se - sb * sd) AS m0, (se * tb - sb * te) / (sa * se - sb * sd) AS m1,
    (se * (tc - sc) - sb * (tf - sf)) / (sa * se - sb * sd) AS m2, (sa * td - sd * ta) / (sa * se - sb * sd) AS m3,
    (sa * te - sd * tb) / (sa * se - sb * sd) AS m4, (sa * (tf - sf) - sd * (tc - sc)) / (sa * se - sb * sd) AS m5 FROM g
), rows_ AS (SELECT *, unnest(range(0, th)) AS y FROM m), px AS (
  SELECT *, m0 * (x + 0.5e0) + m1 * (y + 0.5e0) + m2 AS u, m3 * (x + 0.5e0) + m4 * (y + 0.5e0) + m5 AS v
  FROM (SELECT *, unnest(range(0, tw)) AS x FROM rows_)
), corners AS (
  SELECT scene_id, y, x, CAST(floor(v - 0.5e0) AS BIGINT) + dy AS sy, CAST(floor(u - 0.5e0) AS BIGINT) + dx AS sx,
    (CASE WHEN dy = 1 THEN v - 0.5e0 - floor(v - 0.5e0) ELSE 1 - (v - 0.5e0 - floor(v - 0.5e0)) END)
    * (CASE WHEN dx = 1 THEN u - 0.5e0 - floor(u - 0.5e0) ELSE 1 - (u - 0.5e0 - floor(u - 0.5e0)) END) AS w
  FROM px, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)
), smooth AS (
  SELECT c.scene_id, c.y, c.x, CASE WHEN sum(w) > 0 THEN sum(w * b08) / sum(w) END AS b08 FROM corners c
  JOIN raster r ON r.scene_id = c.scene_id AND r.y = c.sy AND r.x = c.sx GROUP BY ALL
)
SELECT px.scene_id, px.y, px.x, round(s.b08, 6) AS b08, CAST(r.scl AS DOUBLE) AS scl FROM px
LEFT JOIN smooth s ON s.scene_id = px.scene_id AND s.y = px.y AND s.x = px.x
LEFT JOIN raster r ON r.scene_id = px.scene_id AND r.y = CAST(floor(v) AS BIGINT) AND r.x = CAST(floor(u) AS BIGINT)""",
    ("raster", "scenes"),
)
def band_warp(d: Data):
    grids = d.sql(TURNED.format(scenes="{scenes}", **AFFINE).replace("BIGINT", "LONG"), "scenes")
    grids = grids.select(
        "scene_id",
        F.array("ta", "tb", "tc", "td", "te", "tf").alias("target"),
        F.array("sa", "sb", "sc", "sd", "se", "sf").alias("source"),
        F.col("tw").alias("width"),
        F.col("th").alias("height"),
    )
    found = warp.warp(packed(d, ["b08", "scl"]), grids, ["b08"], ["scl"], BLOCK)
    return found.withColumn("b08", F.round("b08", 6))


# Areas of many sizes, one of them the whole world.
AREAS = """
SELECT c_custkey AS area_id, CASE WHEN c_custkey = 7 THEN -180e0 ELSE CAST(c_custkey % 89 AS DOUBLE) + 0.25e0 END AS left_x,
  CASE WHEN c_custkey = 7 THEN -90e0 ELSE CAST(c_custkey % 53 AS DOUBLE) - 0.5e0 END AS bottom_y,
  CASE WHEN c_custkey = 7 THEN 180e0 ELSE CAST(c_custkey % 89 AS DOUBLE) + 0.25e0 + CAST(c_custkey % 6 AS DOUBLE) / 4e0 END AS right_x,
  CASE WHEN c_custkey = 7 THEN 90e0 ELSE CAST(c_custkey % 53 AS DOUBLE) - 0.5e0 + CAST(c_custkey % 11 AS DOUBLE) END AS top_y FROM {customer}
"""


@query(
    "scene_catalogue_join",
    f"""
WITH areas AS ({AREAS.format(customer="customer")})
SELECT area_id, scene_id, c.date, row_number() OVER (PARTITION BY area_id ORDER BY c.date DESC, scene_id) AS rank
FROM areas a JOIN catalogue c ON c.left_x <= a.right_x AND c.right_x >= a.left_x AND c.bottom_y <= a.top_y AND c.top_y >= a.bottom_y
WHERE c.date BETWEEN '1995-01-01' AND '1997-12-31' AND cloud_cover < 60
QUALIFY rank <= 3""",
    ("catalogue",),
)
def scene_catalogue_join(d: Data):
    box = F.array("left_x", "bottom_y", "right_x", "top_y").alias("bounds")
    areas = d.sql(AREAS, "customer").select("area_id", box)
    items = d.view("catalogue").withColumn("bounds", box)
    found = overlap.scenes_of_areas(items, areas, "1995-01-01", "1997-12-31", 60.0, 3)
    return found.select("area_id", "scene_id", "date", F.col("rank").cast("long").alias("rank"))
