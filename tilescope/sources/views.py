"""Imagery-shaped views over the given tables, as SQL text both engines accept.

Where the dialects differ the engine-specific text is given for DuckDB as well.
`{name}` stands for an input table or view.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    inputs: tuple[str, ...]
    spark: str
    duck: str | None = None

    def duck_sql(self) -> str:
        text = self.duck or self.spark
        return text.format(**{n: n for n in self.inputs})


TILES = """
SELECT vec_id, embedding, label, cell, scene_no, date, sensor, cloud, tile_row, tile_col, 'aoi' AS site,
       concat('aoi_', date, '_r', CAST(tile_row AS STRING), '_c', CAST(tile_col AS STRING), '_', date) AS tile_id
FROM (
  SELECT vec_id, embedding, label,
         CAST(floor(vec_id / 3) AS BIGINT) AS cell,
         CAST(vec_id % 3 AS INT) AS scene_no,
         CASE vec_id % 3 WHEN 0 THEN '2023-12-08' WHEN 1 THEN '2024-05-16' ELSE '2024-12-17' END AS date,
         CASE WHEN label < 6 THEN 'Sentinel-2' WHEN label < 8 THEN 'Landsat 8' ELSE 'Sentinel-1' END AS sensor,
         CAST(label * 7 % 20 AS DOUBLE) / 100 AS cloud,
         CAST(floor(floor(vec_id / 3) / 26) AS BIGINT) * 256 AS tile_row,
         (CAST(floor(vec_id / 3) AS BIGINT) % 26) * 256 AS tile_col
  FROM {embeddings}
) AS base
"""

# Tiles plus repeated points (another id for the same tile) and foreign test points.
POINTS = """
SELECT concat('p', CAST(vec_id AS STRING), '-1') AS point_id, tile_id, site, date, sensor, tile_row, tile_col,
       cell, label, cloud, vec_id, 1 AS version, embedding
FROM {tiles}
UNION ALL
SELECT concat('p', CAST(vec_id AS STRING), '-2'), tile_id, site, date, sensor, tile_row, tile_col,
       cell, label, cloud, vec_id, 2, embedding
FROM {tiles} WHERE vec_id % 4 = 0
UNION ALL
SELECT concat('q', CAST(vec_id AS STRING), '-1'), concat('test_', tile_id), site, '2020-01-01', sensor, tile_row, tile_col,
       cell, label, cloud, vec_id, 1, embedding
FROM {tiles} WHERE vec_id % 17 = 0
"""

TILE_POINTS = """
SELECT vec_id, tile_id, cell, date, sensor, label, tile_row, tile_col, embedding,
       concat('p', CAST(vec_id AS STRING), '-1') AS point_id, 'EPSG:32643' AS crs,
       CAST(274120 + tile_col * 10 AS DOUBLE) AS left_x,
       CAST(2113150 - tile_row * 10 - 2560 AS DOUBLE) AS bottom_y,
       CAST(274120 + tile_col * 10 + 2560 AS DOUBLE) AS right_x,
       CAST(2113150 - tile_row * 10 AS DOUBLE) AS top_y
FROM {tiles}
"""

PIXELS_MS = """
SELECT l_suppkey AS tile, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS t,
       l_tax * 10000 AS b02, l_quantity * 40 AS b03, l_discount * 10000 + 200 AS b04,
       l_extendedprice / 20 AS b08, CAST(l_partkey % 4000 AS DOUBLE) AS b11, l_linenumber + 3 AS scl
FROM {lineitem}
"""

PIXELS_GREY = """
SELECT vec_id, cell, scene_no, tile_id, pos AS px, greatest(0.0D, least(1.0D, 0.5D + 2 * CAST(v AS DOUBLE))) AS level
FROM {tiles} LATERAL VIEW posexplode(embedding) AS pos, v
"""
PIXELS_GREY_DUCK = """
SELECT vec_id, cell, scene_no, tile_id, px,
       greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + 2 * CAST(v AS DOUBLE))) AS level
FROM (SELECT vec_id, cell, scene_no, tile_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS px FROM {tiles})
"""

# Four scenes of 50-px-wide rasters; their height grows with the table. Some
# 16-px squares are partly zero (no data) or partly white (cloud).
RASTER = """
SELECT scene_id, y, x,
       CASE WHEN dead THEN 0 WHEN white THEN 250 ELSE (custkey * 7 + orderkey * 13) % 256 END AS b02,
       CASE WHEN dead THEN 0 WHEN white THEN 250 ELSE CAST(floor(price) AS BIGINT) % 256 END AS b03,
       CASE WHEN dead THEN 0 WHEN white THEN 250 ELSE CAST(floor(price / 256) AS BIGINT) % 256 END AS b04,
       CASE WHEN dead THEN 0 ELSE (custkey * 3 + CAST(floor(price / 7) AS BIGINT)) % 256 END AS b08,
       CASE WHEN dead THEN 0 ELSE CAST(floor(price / 11) AS BIGINT) % 256 END AS b11,
       CASE WHEN dead THEN 0 WHEN white THEN 9 ELSE CAST(floor(price / 13) AS BIGINT) % 12 END AS scl
FROM (
  SELECT scene_id, y, x, orderkey, custkey, price,
         (CAST(floor(y / 16) AS BIGINT) + CAST(floor(x / 16) AS BIGINT) + scene_id) % 5 = 0 AND (y * 7 + x * 3) % 10 < 3 AS dead,
         (CAST(floor(y / 16) AS BIGINT) + CAST(floor(x / 16) AS BIGINT) + scene_id) % 5 = 2 AND (y * 7 + x * 3) % 10 < 2 AS white
  FROM (
    SELECT o_orderkey % 4 AS scene_id,
           CAST(floor(CAST(floor(o_orderkey / 4) AS BIGINT) / 50) AS BIGINT) AS y,
           CAST(floor(o_orderkey / 4) AS BIGINT) % 50 AS x,
           o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS price
    FROM {orders}
  ) AS placed
) AS marked
"""

SCENES = """
SELECT scene_id, CAST(50 AS BIGINT) AS width, max(y) + 1 AS height,
       CASE WHEN scene_id < 2 THEN 0 END AS nodata,
       CASE scene_id WHEN 0 THEN '2023-12-08' WHEN 1 THEN '2024-05-16' WHEN 2 THEN '2024-12-17' ELSE '2025-03-01' END AS date,
       CASE WHEN scene_id < 3 THEN 'Sentinel-2' ELSE 'Landsat 8' END AS sensor,
       concat('scene_', CAST(scene_id AS STRING)) AS stem, 'aoi' AS site,
       CASE WHEN scene_id = 3 THEN 'EPSG:32644' ELSE 'EPSG:32643' END AS crs,
       CAST(10 AS DOUBLE) AS aff_a, CAST(0 AS DOUBLE) AS aff_b, CAST(274120 AS DOUBLE) AS aff_c,
       CAST(0 AS DOUBLE) AS aff_d, CAST(-10 AS DOUBLE) AS aff_e,
       CAST(CASE WHEN scene_id = 2 THEN 2113160 ELSE 2113150 END AS DOUBLE) AS aff_f
FROM {raster} GROUP BY scene_id
"""

# Every order as a catalogued scene: a one-degree footprint, a date and a cloud share.
CATALOGUE = """
SELECT o_orderkey AS scene_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
       CAST(o_orderkey * 17 % 1000 AS DOUBLE) / 10 AS cloud_cover,
       CAST(o_custkey % 90 AS DOUBLE) AS left_x, CAST(o_orderkey % 60 AS DOUBLE) AS bottom_y,
       CAST(o_custkey % 90 + 1 AS DOUBLE) AS right_x, CAST(o_orderkey % 60 + 1 AS DOUBLE) AS top_y
FROM {orders}
"""

REVIEW_QUEUE = """
SELECT o_orderkey AS id, concat('aoi_c', CAST(o_custkey AS STRING)) AS tile_id,
       CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'CONFIRMED' ELSE 'REJECTED' END AS status,
       o_totalprice / 500000 AS confidence,
       CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 400000 END AS drift_score,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('note ', o_orderpriority) END AS remarks,
       CASE WHEN o_orderkey % 11 = 0 THEN '{{bad'
            WHEN o_orderkey % 3 > 0 THEN concat('{{"type":"Polygon","crs":"EPSG:32643","bounds":[',
                 CAST(o_custkey AS STRING), ',', CAST(o_custkey + 1 AS STRING), ',', CAST(o_custkey + 2 AS STRING), ',',
                 CAST(o_custkey + 3 AS STRING), ']}}') END AS bbox_json,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM {orders}
"""

# An upsert feed for the audit ledger, ordered by (ts, event_id).
AUDIT_CHANGES = """
SELECT concat('aoi_u', CAST(user_id AS STRING)) AS id, concat('/tiles/', CAST(event_id AS STRING), '.png') AS image_path,
       CASE WHEN event_type = 'view' THEN 'unassigned' ELSE event_type END AS primary_tag,
       CAST(event_id % 4 AS INT) AS cluster,
       CASE WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) ELSE value / 500 END AS anomaly_score,
       CASE WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status,
       CASE WHEN event_id % 2 = 0 THEN concat('before ', CAST(event_id AS STRING)) END AS before_desc,
       CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 2 = 0 THEN 'Sentinel-2' ELSE 'Landsat 8' END AS sensor,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date,
       ts, event_id
FROM {events}
"""

# First and last scene of every cell, keyed by composite id, as stored change rows.
PAIR_LEDGER = """
SELECT CASE WHEN a.cell % 5 = 0 THEN b.tile_id
            WHEN a.cell % 7 = 0 THEN concat('gone_', a.tile_id, '__', b.tile_id)
            ELSE concat(a.tile_id, '__', b.tile_id) END AS id,
       a.tile_id AS t1_tile_id, b.tile_id AS t2_tile_id, a.cell AS cell,
       concat('/tiles/', b.tile_id, '.png') AS image_path,
       CASE WHEN a.label % 3 = 0 THEN 'unassigned' WHEN a.label % 3 = 1 THEN 'detected-change' ELSE 'urban-change' END AS primary_tag,
       a.label AS cluster,
       CASE WHEN a.cell % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(a.cell * 37 % 130 AS DOUBLE) / 100 END AS anomaly_score,
       CASE WHEN a.cell % 4 = 0 THEN 'accepted' ELSE 'pending' END AS status,
       CASE WHEN a.cell % 3 = 0 THEN '' ELSE concat('before ', a.date) END AS before_desc,
       concat('after ', b.date) AS after_desc,
       concat('/tiles/', a.tile_id, '_before.png') AS before_image_path,
       concat('/tiles/', b.tile_id, '_after.png') AS after_image_path,
       CASE WHEN a.cell % 2 = 0 THEN a.sensor END AS sensor,
       CASE WHEN a.cell % 3 > 0 THEN b.date END AS date,
       CAST(a.cell % 8 * 5 AS DOUBLE) AS cloud_cover,
       CAST('2025-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM {tiles} AS a JOIN {tiles} AS b ON a.cell = b.cell AND a.scene_no = 0 AND b.scene_no = 2
"""

PAIR_REVIEWS = """
SELECT cell AS id, CASE WHEN cell % 4 = 0 THEN t2_tile_id ELSE concat(t1_tile_id, '__', t2_tile_id) END AS tile_id,
       t1_tile_id, t2_tile_id,
       CASE WHEN cell % 3 = 0 THEN 'PENDING' WHEN cell % 3 = 1 THEN 'CONFIRMED' ELSE 'FLAGGED' END AS status,
       CAST(cell % 10 AS DOUBLE) / 10 AS confidence,
       CASE WHEN cell % 9 > 0 THEN CAST(cell * 7 % 100 AS DOUBLE) / 100 END AS drift_score,
       CASE WHEN cell % 2 = 0 THEN 'checked' END AS remarks,
       '2023-12-08' AS date_t1, CASE WHEN cell % 5 > 0 THEN '2024-12-17' END AS date_t2,
       concat('{{"type":"Polygon","crs":"EPSG:32643","bounds":[', CAST(cell AS STRING), ',0,1,2]}}') AS bbox_json,
       CAST('2025-02-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('2025-02-02 00:00:00' AS TIMESTAMP) AS updated_at
FROM {pair_ledger} WHERE cell % 3 < 2
"""

# Clicks on the map: one per customer, spread over the tiles' area.
CLICKS = """
SELECT c_custkey AS click_id,
       19.0 + CAST(c_custkey * 7 % 1000 AS DOUBLE) / 5000 AS lat,
       72.8 + CAST(c_custkey * 13 % 1000 AS DOUBLE) / 1500 AS lng
FROM {customer}
"""

# Scored pairs with a label, for classifier reports: one row per document label.
JUDGED = """
SELECT doc_id, quality AS label, CASE WHEN toxic = 1 THEN 0 ELSE CAST(doc_id % 2 AS INT) END AS prediction,
       CAST(doc_id * 29 % 97 AS DOUBLE) / 100 AS confidence
FROM {labels}
"""

VIEWS: dict[str, View] = {
    "tiles": View(("embeddings",), TILES),
    "points": View(("tiles",), POINTS),
    "tile_points": View(("tiles",), TILE_POINTS),
    "pixels_ms": View(("lineitem",), PIXELS_MS),
    "pixels_grey": View(("tiles",), PIXELS_GREY, PIXELS_GREY_DUCK),
    "raster": View(("orders",), RASTER),
    "scenes": View(("raster",), SCENES),
    "catalogue": View(("orders",), CATALOGUE),
    "review_queue": View(("orders",), REVIEW_QUEUE),
    "audit_changes": View(("events",), AUDIT_CHANGES),
    "pair_ledger": View(("tiles",), PAIR_LEDGER),
    "pair_reviews": View(("pair_ledger",), PAIR_REVIEWS),
    "clicks": View(("customer",), CLICKS),
    "judged": View(("labels",), JUDGED),
}


def with_views(body: str, *names: str) -> str:
    """DuckDB text: `body` preceded by the named views and all they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for parent in VIEWS[name].inputs:
            if parent in VIEWS:
                need(parent)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{n} AS ({VIEWS[n].duck_sql().strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
