"""Queries for vector search, filters and positions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilescope.config import SceneExtent
from tilescope.functions import geodesy, identity, projection, vectors
from tilescope.operators import hotspots, search
from tilescope.plans.registry import D1, D3, REGISTRY, Data, query, r6
from tilescope.session import shared_folder
from tilescope.sources.metric_index import MetricIndex

EXTENT = SceneExtent(top=19.28, left=72.72, height_deg=0.43, width_deg=0.33)

# DuckDB: cosine of a stored vector with the one of vec_id 7.
SCORED = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
scored AS (SELECT p.*, list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), q.v) AS score FROM points p, q)
"""


@query(
    "knn_search",
    SCORED
    + """, best AS (
  SELECT * FROM scored WHERE sensor = 'Sentinel-2'
  QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, point_id) = 1
)
SELECT row_number() OVER (ORDER BY score DESC, tile_id) AS rank, tile_id, date, sensor, round(score, 6) AS score
FROM best ORDER BY score DESC, tile_id LIMIT 10""",
    ("points",),
)
def knn_search(d: Data):
    hits = search.knn_search(
        d.points, d.vectors([7])[0], 10, sensor="Sentinel-2", tie=("tile_id", "point_id")
    ).select("tile_id", "date", "sensor", "score")
    # At most top_k rows are left, so ranking them in one place is safe.
    return ranked(hits)


def ranked(hits):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "tile_id")).cast("long")
    return hits.select(rank.alias("rank"), "tile_id", "date", "sensor", r6("score"))


@query(
    "knn_batch",
    """
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (1, 2, 3)),
scored AS (SELECT q.qid, t.tile_id, list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), q.v) AS score FROM tiles t, q)
SELECT 'q' || qid AS query, tile_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tile_id) AS rank
FROM scored QUALIFY rank <= 5""",
    ("tiles",),
)
def knn_batch(d: Data):
    asked = list(zip(["q1", "q2", "q3"], d.vectors([1, 2, 3])))
    hits = search.knn_batch(d.tiles, asked, 5)
    return hits.select("query", "tile_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "knn_table",
    """
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (SELECT q.vec_id, t.tile_id, list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), q.v) AS score FROM tiles t, q)
SELECT CAST(vec_id AS VARCHAR) AS query, tile_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tile_id) AS rank FROM scored QUALIFY rank <= 5""",
    ("tiles",),
)
def knn_table(d: Data):
    asked = d.table("embeddings")
    asked = asked.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"))
    hits = search.knn_table(d.tiles, asked, 5)
    return hits.select("query", "tile_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "dedupe_hits",
    SCORED
    + """, hits AS (SELECT point_id, CASE WHEN label = 9 THEN '' ELSE tile_id END AS tile_id, score FROM scored)
SELECT point_id, tile_id, round(score, 6) AS score FROM hits WHERE tile_id = ''
UNION ALL
SELECT point_id, tile_id, round(score, 6) AS score FROM (
  SELECT * FROM hits WHERE tile_id <> '' QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, point_id DESC) = 1)""",
    ("points",),
)
def dedupe_hits(d: Data):
    scored = d.points.select(
        "point_id",
        F.when(F.col("label") == 9, "").otherwise(F.col("tile_id")).alias("tile_id"),
        vectors.cosine_to_one(F.col("embedding"), d.vectors([7])[0]).alias("score"),
    )
    best = search.dedupe_hits(scored, [F.col("point_id").desc()])
    return best.select("point_id", "tile_id", r6("score"))


@query(
    "meta_filter",
    "SELECT vec_id, tile_id FROM tiles WHERE date = '2024-12-17' AND sensor = 'Landsat 8'",
    ("tiles",),
)
def meta_filter(d: Data):
    return search.meta_filter(d.tiles, D3, "Landsat 8").select("vec_id", "tile_id")


@query(
    "filter_by_tag",
    "SELECT id, anomaly_score, status FROM pair_ledger WHERE primary_tag = 'urban-change' ORDER BY id LIMIT 10",
    ("pair_ledger",),
)
def filter_by_tag(d: Data):
    return search.filter_by_tag(d.view("pair_ledger"), "urban-change").select("id", "anomaly_score", "status")


@query(
    "tile_alias_resolve",
    """
WITH a AS (
  SELECT id, 0 AS alias_rank, split_part(id, '__', 2) AS tile_id FROM pair_ledger WHERE contains(id, '__')
  UNION ALL SELECT id, 1, split_part(id, '__', 1) FROM pair_ledger WHERE contains(id, '__')
  UNION ALL SELECT id, CASE WHEN contains(id, '__') THEN 2 ELSE 0 END, id FROM pair_ledger
)
SELECT id AS request_id, alias_rank, t.tile_id, t.vec_id FROM a JOIN tiles t USING (tile_id)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY alias_rank) = 1""",
    ("pair_ledger",),
)
def tile_alias_resolve(d: Data):
    asked = d.view("pair_ledger").select(F.col("id").alias("request_id"))
    return search.resolve_alias(asked, d.tiles.select("tile_id", "vec_id"))


SIMILAR_ID = "aoi_2023-12-08_r0_c512_2023-12-08__aoi_2024-12-17_r0_c512_2024-12-17"


@query(
    "similar_tile",
    f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM tiles WHERE tile_id = '{SIMILAR_ID.split("__")[1]}'),
scored AS (
  SELECT p.*, list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), q.v) AS score FROM points p, q
  WHERE tile_id NOT IN ('{SIMILAR_ID.split("__")[0]}', '{SIMILAR_ID.split("__")[1]}', '{SIMILAR_ID}')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, point_id) = 1)
SELECT row_number() OVER (ORDER BY score DESC, tile_id) AS rank, tile_id, date, sensor, round(score, 6) AS score
FROM best ORDER BY score DESC, tile_id LIMIT 6""",
    ("points",),
)
def similar_tile(d: Data):
    return ranked(search.similar_tile(d.points, SIMILAR_ID, 6).select("tile_id", "date", "sensor", "score"))


@query(
    "change_id_split",
    """
SELECT id, CASE WHEN contains(id, '__') THEN split_part(id, '__', 1) WHEN contains(id, '2023-12-08') THEN id
    ELSE replace(id, '2024-12-17', '2023-12-08') END AS t1,
  CASE WHEN contains(id, '__') THEN split_part(id, '__', 2) WHEN contains(id, '2023-12-08') THEN replace(id, '2023-12-08', '2024-12-17')
    ELSE id END AS t2
FROM (SELECT id FROM pair_ledger UNION ALL SELECT tile_id FROM tiles)""",
    ("pair_ledger",),
)
def change_id_split(d: Data):
    ids = d.view("pair_ledger").select("id").unionAll(d.tiles.select("tile_id"))
    halves = identity.split_change_id(F.col("id"), D1, D3)
    return ids.select("id", halves.alias("h")).select("id", "h.t1", "h.t2")


@query(
    "rc_from_id",
    r"""
SELECT id, coalesce(try_cast(regexp_extract(id, '_r(\d+)_c(\d+)', 1) AS INT), 256) AS tile_row,
  coalesce(try_cast(regexp_extract(id, '_r(\d+)_c(\d+)', 2) AS INT), 256) AS tile_col
FROM (SELECT id FROM pair_ledger UNION ALL SELECT DISTINCT tile_id FROM review_queue)""",
    ("pair_ledger", "review_queue"),
)
def rc_from_id(d: Data):
    ids = d.view("pair_ledger").select("id").unionAll(d.view("review_queue").select("tile_id").distinct())
    row, col = identity.grid_position(F.col("id"))
    return ids.select("id", row.alias("tile_row"), col.alias("tile_col"))


# DuckDB: inverse transverse Mercator (zone 43 north) of a bbox centre.
UTM_SQL = """
WITH p AS (
  SELECT *, (left_x + right_x) / 2 - 500000 AS x, (bottom_y + top_y) / 2 AS y, 6378137.0::DOUBLE AS a, 0.0066943799901413165::DOUBLE AS e2,
    0.006739496742276434::DOUBLE AS ep, 0.0016792203863837047::DOUBLE AS e1 FROM tile_points
), m AS (
  SELECT *, y / 0.9996 / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu FROM p
), f AS (
  SELECT *, mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * sin(4 * mu)
    + (151 * e1 ** 3 / 96) * sin(6 * mu) + (1097 * e1 ** 4 / 512) * sin(8 * mu) AS p1 FROM m
), g AS (
  SELECT *, ep * cos(p1) ** 2 AS c, tan(p1) ** 2 AS t, a / sqrt(1 - e2 * sin(p1) ** 2) AS n,
    a * (1 - e2) / (1 - e2 * sin(p1) ** 2) ** 1.5 AS r FROM f
), h AS (SELECT *, x / (n * 0.9996) AS d FROM g),
located AS (
  SELECT *, degrees(p1 - n * tan(p1) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * ep) * d ** 4 / 24
      + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * ep - 3 * c ** 2) * d ** 6 / 720)) AS lat,
    75 + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * ep + 24 * t ** 2) * d ** 5 / 120) / cos(p1)) AS lng
  FROM h
)
"""


@query(
    "bbox_center_wgs84",
    UTM_SQL + "SELECT tile_id, round(lat, 5) AS lat, round(lng, 5) AS lng FROM located",
    ("tile_points",),
)
def bbox_center_wgs84(d: Data):
    # Two different series are compared, so to about a metre.
    spots = geodesy.add_center_wgs84(d.tile_points)
    return spots.select("tile_id", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query("bbox_center_by_definition", REGISTRY["bbox_center_wgs84"].sql)
def bbox_center_by_definition(d: Data):
    systems = projection.system_table(d.spark, {"EPSG:32643": "+proj=utm +zone=43 +datum=WGS84"})
    x, y = geodesy.bbox_center(F.col("bounds"))
    spots = projection.add_degrees(d.tile_points, systems, x, y)
    return spots.select("tile_id", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query(
    "grid_geolocate",
    r"""
WITH rc AS (
  SELECT id, coalesce(try_cast(regexp_extract(id, '_r(\d+)_c(\d+)', 1) AS INT), 256) AS r,
    coalesce(try_cast(regexp_extract(id, '_r(\d+)_c(\d+)', 2) AS INT), 256) AS c FROM pair_ledger
)
SELECT id, round(19.28 - (r + 128) / 1024 * 0.43, 6) AS lat, round(72.72 + (c + 128) / 1024 * 0.33, 6) AS lng FROM rc""",
    ("pair_ledger",),
)
def grid_geolocate(d: Data):
    spot = geodesy.grid_geolocate(F.col("id"), EXTENT)
    return d.view("pair_ledger").select("id", spot.alias("s")).select("id", r6("s.lat", "lat"), r6("s.lng", "lng"))


@query(
    "nearest_hotspot",
    UTM_SQL
    + """, spots AS (SELECT tile_id, lat, lng FROM located), near AS (
  SELECT c.click_id, s.tile_id, sqrt((s.lat - c.lat) ** 2 + (s.lng - c.lng) ** 2) AS distance FROM clicks c, spots s
)
SELECT click_id, tile_id, round(distance, 6) AS distance FROM near WHERE distance <= 0.5
QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY round(distance, 12), tile_id DESC) = 1""",
    ("tile_points", "clicks"),
)
def nearest_hotspot(d: Data):
    spots = geodesy.add_center_wgs84(d.tile_points).select("tile_id", "lat", "lng")
    found = hotspots.nearest_hotspot(d.view("clicks"), spots, reach=0.5, order="tile_id")
    return found.select("click_id", "tile_id", r6("distance"))


@query(
    "sensor_family",
    """
SELECT vec_id, sensor FROM tiles WHERE lower(sensor) LIKE 'landsat%' OR contains(lower(sensor), 'l-1')""",
    ("tiles",),
)
def sensor_family(d: Data):
    return d.tiles.filter(search.sensor_family(F.col("sensor"), ["LANDSAT", "l-1", ""])).select("vec_id", "sensor")


@query(
    "date_range",
    "SELECT id, coalesce(date, 'none') AS date FROM audit_changes WHERE date IS NULL OR date = '' OR (date >= '2024-01-03' AND date <= '2024-01-10')",
    ("audit_changes",),
)
def date_range(d: Data):
    rows = d.view("audit_changes").filter(search.date_range(F.col("date"), "2024-01-03", "2024-01-10"))
    return rows.select("id", F.coalesce("date", F.lit("none")).alias("date"))


@query(
    "label_contains",
    """
SELECT event_id, primary_tag FROM audit_changes
WHERE contains(lower(primary_tag), 'purchased') OR contains('purchased', lower(primary_tag))""",
    ("audit_changes",),
)
def label_contains(d: Data):
    rows = d.view("audit_changes").filter(search.label_contains(F.col("primary_tag"), " Purchased "))
    return rows.select("event_id", "primary_tag")


@query(
    "confidence_band",
    """
SELECT event_id, CASE WHEN anomaly_score > 0.7 THEN 'high' WHEN anomaly_score >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM audit_changes""",
    ("audit_changes",),
)
def confidence_band(d: Data):
    return d.view("audit_changes").select("event_id", identity.confidence_band(F.col("anomaly_score")).alias("band"))


@query(
    "cosine",
    """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(d: Data):
    return neighbours(d).select("vec_id", r6(vectors.cosine(F.col("a"), F.col("b")), "cosine"))


def neighbours(d: Data):
    e = d.table("embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


@query(
    "drift",
    """
SELECT a.vec_id, round(greatest(0, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS drift
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def drift(d: Data):
    return neighbours(d).select("vec_id", r6(vectors.drift(vectors.cosine(F.col("a"), F.col("b"))), "drift"))


@query(
    "raw_drift",
    """
SELECT a.vec_id, round(greatest(0, 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS raw_drift
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def raw_drift(d: Data):
    return neighbours(d).select("vec_id", r6(vectors.raw_drift(F.col("a"), F.col("b")), "raw_drift"))


def indexed(d: Data) -> MetricIndex:
    """All points but the last scene's as built, the last scene's upserted."""
    index = MetricIndex(d.spark, f"{shared_folder(d.spark).rstrip('/')}/index/{uuid.uuid4().hex}")
    index.build(d.points.filter(F.col("date") != D3), slice_rows=256)
    index.upsert(d.points.filter(F.col("date") == D3))
    return index


@query("knn_search_index", REGISTRY["knn_search"].sql)
def knn_search_index(d: Data):
    hits = indexed(d).search(d.vectors([7])[0], 10, sensor="Sentinel-2", tie=("tile_id", "point_id"))
    return ranked(hits.select("tile_id", "date", "sensor", "score"))


@query("similar_tile_index", REGISTRY["similar_tile"].sql)
def similar_tile_index(d: Data):
    return ranked(indexed(d).similar(SIMILAR_ID, 6).select("tile_id", "date", "sensor", "score"))
