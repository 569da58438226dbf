"""Queries for the ledgers, the review queue, hotspots and provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilescope.functions import identity
from tilescope.operators import containment, hotspots, ledger, provenance, review, spectral
from tilescope.operators.quality import cloud_ratio
from tilescope.plans.registry import D1, D3, REGISTRY, Data, query, r6, text_of
from tilescope.plans.search_queries import EXTENT, UTM_SQL
from tilescope.session import shared_folder
from tilescope.sources.bucket_store import BucketStore
from tilescope.sources.document_sink import HASH_CHARS, write_documents

CUT = "2024-01-15"
ORDER = ["ts", "event_id"]


def now():
    return F.to_timestamp_ntz(F.lit("2025-03-01 00:00:00"))


def ledger_now(d: Data):
    """The audit ledger after the whole feed."""
    return ledger.reduce_feed(d.view("audit_changes"), ORDER)


LEDGER = """
WITH ledger AS (
  SELECT id, arg_max(image_path, (ts, event_id)) AS image_path, arg_max(primary_tag, (ts, event_id)) AS primary_tag,
    arg_max(cluster, (ts, event_id)) AS cluster, arg_max(anomaly_score, (ts, event_id)) AS anomaly_score,
    arg_max(status, (ts, event_id)) AS status, arg_max(sensor, (ts, event_id)) FILTER (WHERE sensor IS NOT NULL) AS sensor,
    arg_max(date, (ts, event_id)) FILTER (WHERE date IS NOT NULL) AS date, min(ts) AS created_at,
    arg_max(coalesce(before_desc, ''), (ts, event_id)) AS before_desc
  FROM audit_changes GROUP BY id
)
"""


@query(
    "audit_upsert",
    LEDGER
    + """
SELECT id, image_path, primary_tag, cluster, round(anomaly_score, 6) AS anomaly_score, status, before_desc,
  coalesce(sensor, 'none') AS sensor, coalesce(date, 'none') AS date, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ledger""",
    ("audit_changes",),
)
def audit_upsert(d: Data):
    # The ledger as it stood at the cut, then the rest of the feed merged in.
    feed = d.view("audit_changes")
    stored = ledger.reduce_feed(feed.filter(F.col("ts") < CUT), ORDER)
    merged = ledger.audit_upsert(stored, feed.filter(F.col("ts") >= CUT), ORDER)
    return merged.select(
        "id",
        "image_path",
        "primary_tag",
        "cluster",
        r6("anomaly_score"),
        "status",
        F.coalesce("before_desc", F.lit("")).alias("before_desc"),
        F.coalesce("sensor", F.lit("none")).alias("sensor"),
        F.coalesce("date", F.lit("none")).alias("date"),
        text_of("created_at").alias("created_at"),
    )


@query(
    "audit_status_update",
    """
SELECT l.id, coalesce(lower(r.status), l.status) AS status FROM pair_ledger l LEFT JOIN pair_reviews r ON r.tile_id = l.id""",
    ("pair_ledger", "pair_reviews"),
)
def audit_status_update(d: Data):
    decisions = d.view("pair_reviews").select(F.col("tile_id").alias("id"), F.lower("status").alias("new_status"))
    return ledger.status_update(d.view("pair_ledger"), decisions).select("id", "status")


@query(
    "schema_evolve",
    "SELECT id, image_path, 'absent' AS before_desc, -1 AS cluster FROM pair_ledger",
    ("pair_ledger",),
)
def schema_evolve(d: Data):
    old = d.view("pair_ledger").select("id", "image_path")
    new = ledger.schema_evolve(old, {"image_path": "string", "before_desc": "string", "cluster": "int"})
    return new.select(
        "id", "image_path", F.coalesce("before_desc", F.lit("absent")).alias("before_desc"), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )


@query(
    "review_append",
    """
WITH added AS (
  SELECT (SELECT max(id) FROM review_queue) + row_number() OVER (ORDER BY t1_tile_id, t2_tile_id) AS id, id AS tile_id, 'PENDING' AS status,
    anomaly_score AS confidence, TIMESTAMP '2025-03-01 00:00:00' AS created_at FROM pair_ledger
)
SELECT id, tile_id, status, round(confidence, 9) AS confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM added
UNION ALL SELECT id, tile_id, status, round(confidence, 9), strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM review_queue""",
    ("review_queue", "pair_ledger"),
)
def review_append(d: Data):
    rows = d.view("pair_ledger").select(
        F.col("id").alias("tile_id"),
        "t1_tile_id",
        "t2_tile_id",
        F.lit("PENDING").alias("status"),
        F.col("anomaly_score").alias("confidence"),
    )
    queue = review.review_append(d.view("review_queue"), rows, ["t1_tile_id", "t2_tile_id"], now())
    return queue.select("id", "tile_id", "status", F.round("confidence", 9).alias("confidence"), text_of("created_at").alias("created_at"))


UPDATES = """
SELECT user_id AS id, CASE max(event_id) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'FLAGGED' END AS new_status,
  CASE WHEN max(event_id) % 2 = 0 THEN max(value) / 1000 END AS new_confidence,
  CASE WHEN max(event_id) % 6 > 1 THEN concat('seen ', CAST(count(*) AS STRING)) END AS new_remarks
FROM {events} GROUP BY user_id
"""


@query(
    "review_update",
    f"""
SELECT q.id, coalesce(u.new_status, status) AS status, round(coalesce(u.new_confidence, confidence), 9) AS confidence,
  coalesce(u.new_remarks, remarks, 'none') AS remarks,
  strftime(CASE WHEN u.id IS NULL THEN updated_at ELSE TIMESTAMP '2025-03-01 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM review_queue q LEFT JOIN ({UPDATES.format(events="events")}) u
  ON q.id = u.id AND (new_status IS NOT NULL OR new_confidence IS NOT NULL OR new_remarks IS NOT NULL)""",
    ("review_queue",),
)
def review_update(d: Data):
    asked = d.sql(UPDATES, "events").filter(
        F.coalesce("new_status", F.col("new_confidence").cast("string"), "new_remarks").isNotNull()
    )
    queue = review.review_update(d.view("review_queue"), asked, now())
    return queue.select(
        "id", "status", F.round("confidence", 9).alias("confidence"), F.coalesce("remarks", F.lit("none")).alias("remarks"), text_of("updated_at").alias("updated_at")
    )


@query(
    "review_page",
    """
SELECT id, tile_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM review_queue WHERE status = 'PENDING'
ORDER BY review_queue.created_at DESC, id DESC LIMIT 100 OFFSET 100""",
    ("review_queue",),
)
def review_page(d: Data):
    page = review.review_page(d.view("review_queue"), "PENDING", 100, 100)
    return page.select("id", "tile_id", text_of("created_at").alias("created_at"))


@query(
    "review_get",
    """
SELECT tile_id, id, status FROM review_queue WHERE tile_id IN (SELECT 'aoi_c' || c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY id) = 1""",
    ("review_queue",),
)
def review_get(d: Data):
    asked = d.table("customer").select(F.concat(F.lit("aoi_c"), "c_custkey").alias("tile_id"))
    return review.review_get(d.view("review_queue"), asked).select("tile_id", "id", "status")


@query(
    "record_fuzzy_match",
    """
SELECT id, tile_id, CASE WHEN CAST(id AS STRING) = 'aoi_c12' THEN 0 WHEN tile_id = 'aoi_c12' THEN 1 ELSE 2 END AS match_grade FROM review_queue
WHERE CAST(id AS STRING) = 'aoi_c12' OR tile_id = 'aoi_c12' OR contains(tile_id, 'aoi_c12') OR contains('aoi_c12', tile_id)
ORDER BY match_grade, created_at DESC, id DESC""",
    ("review_queue",),
)
def record_fuzzy_match(d: Data):
    return review.record_fuzzy_match(d.view("review_queue"), "aoi_c12").select("id", "tile_id", "match_grade")


@query(
    "audit_fuzzy_match",
    """
SELECT id, primary_tag, status FROM pair_ledger WHERE contains(id, 'r0_c512')
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1""",
    ("pair_ledger",),
)
def audit_fuzzy_match(d: Data):
    return review.audit_fuzzy_match(d.view("pair_ledger"), "r0_c512").select("id", "primary_tag", "status")


@query(
    "bbox_from_json",
    """
SELECT id, bbox_json IS NOT NULL AND json_valid(bbox_json) AS has_bbox,
  coalesce(CASE WHEN json_valid(bbox_json) THEN CAST(json_extract(bbox_json, '$.bounds[2]') AS DOUBLE) END, -1) AS right_x FROM review_queue""",
    ("review_queue",),
)
def bbox_from_json(d: Data):
    box = review.bbox_from_json(F.col("bbox_json"))
    rows = d.view("review_queue").select("id", box.alias("b"))
    return rows.select(
        "id",
        F.col("b.bounds").isNotNull().alias("has_bbox"),
        F.coalesce(F.get("b.bounds", 2), F.lit(-1.0)).alias("right_x"),
    )


SCORE_TEXT = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat(CAST(event_id % 4 - 1 AS STRING), '.', CAST(event_id % 7 AS STRING)) END AS score FROM {events}"


@query(
    "clamp_confidence",
    f"SELECT event_id, greatest(0, least(1, coalesce(try_cast(score AS DOUBLE), 0))) AS confidence FROM ({SCORE_TEXT.format(events='events')})",
)
def clamp_confidence(d: Data):
    return d.sql(SCORE_TEXT, "events").select("event_id", identity.clamp_confidence(F.col("score")).alias("confidence"))


@query(
    "cloud_cover_pick",
    """
SELECT l.id, CAST(coalesce(nullif(l.cloud_cover, 0), round_even(t.cloud * 100, 0), 5) AS INT) AS cloud_cover
FROM pair_ledger l LEFT JOIN tiles t ON t.tile_id = l.id""",
    ("pair_ledger",),
)
def cloud_cover_pick(d: Data):
    joined = d.view("pair_ledger").join(d.tiles.select(F.col("tile_id").alias("id"), "cloud"), "id", "left")
    return joined.select("id", hotspots.cloud_cover_pick([F.col("cloud_cover")], F.col("cloud")).alias("cloud_cover"))


@query(
    "first_truthy",
    "SELECT id, coalesce(nullif(before_desc, ''), nullif(sensor, ''), nullif(date, ''), 'nothing') AS text FROM pair_ledger",
    ("pair_ledger",),
)
def first_truthy(d: Data):
    picked = F.coalesce(identity.first_truthy("before_desc", "sensor", "date"), F.lit("nothing"))
    return d.view("pair_ledger").select("id", picked.alias("text"))


STATUS_FEED = "SELECT event_id, concat(upper(substring(status, 1, 1)), substring(status, 2)) AS status FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'accepted' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'reject' WHEN 4 THEN 'rejected' WHEN 5 THEN 'flagged' ELSE event_type END AS status FROM {events}) AS s"


@query(
    "status_normalise",
    f"""
SELECT event_id, CASE WHEN lower(status) IN ('accept', 'accepted', 'confirmed') THEN 'CONFIRMED' WHEN lower(status) IN ('reject', 'rejected') THEN 'REJECTED'
  WHEN lower(status) IN ('flag', 'flagged') THEN 'FLAGGED' ELSE 'PENDING' END AS status FROM ({STATUS_FEED.format(events="events")})""",
)
def status_normalise(d: Data):
    return d.sql(STATUS_FEED, "events").select("event_id", identity.normalise_status(F.col("status")).alias("status"))


@query(
    "decision_display",
    f"""
SELECT event_id, CASE upper(status) WHEN 'CONFIRMED' THEN 'accept' WHEN 'REJECTED' THEN 'reject' WHEN 'PENDING' THEN 'pending' WHEN 'FLAGGED' THEN 'flag'
  WHEN 'ACCEPT' THEN 'accept' WHEN 'REJECT' THEN 'reject' WHEN 'FLAG' THEN 'flag' ELSE lower(status) END AS decision
FROM ({STATUS_FEED.format(events="events")})""",
)
def decision_display(d: Data):
    return d.sql(STATUS_FEED, "events").select("event_id", identity.decision_display(F.col("status")).alias("decision"))


@query(
    "safe_name",
    "SELECT page_id, substring(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 32) AS name FROM pages",
)
def safe_name(d: Data):
    return d.table("pages").select("page_id", identity.safe_name(F.col("url"), 32).alias("name"))


# -- point store ---------------------------------------------------------------

STATES = """
WITH states AS (
  SELECT point_id, tile_id, CASE WHEN NOT starts_with(tile_id, 'aoi_') THEN 'stale'
    WHEN row_number() OVER (PARTITION BY tile_id ORDER BY point_id) > 1 THEN 'repeated' ELSE 'valid' END AS state FROM points
)
"""


@query("stale_points", STATES + "SELECT point_id, tile_id, state FROM states WHERE state <> 'valid'", ("points",))
def stale_points(d: Data):
    return ledger.stale_points(d.points, "aoi_").select("point_id", "tile_id", "state")


@query("clean_points", STATES + "SELECT point_id, tile_id FROM states WHERE state = 'valid'", ("points",))
def clean_points(d: Data):
    return ledger.clean_points(d.points, "aoi_").select("point_id", "tile_id")


@query(
    "point_audit",
    STATES
    + """
SELECT count(*) AS total_points, count(*) FILTER (WHERE state = 'valid') AS valid_tiles, count(*) FILTER (WHERE state = 'stale') AS stale_points,
  count(*) FILTER (WHERE state = 'repeated') AS repeated_points FROM states""",
    ("points",),
)
def point_audit(d: Data):
    return ledger.point_audit(d.points, "aoi_")


@query(
    "ingest_status",
    LEDGER
    + """, c AS (
  SELECT count(*) FILTER (WHERE primary_tag = 'unassigned') AS u, count(*) FILTER (WHERE primary_tag <> 'unassigned' OR anomaly_score > 0) AS a,
    min(nullif(date, '')) AS lo, max(nullif(date, '')) AS hi, list_sort(list(DISTINCT nullif(sensor, ''))) AS s FROM ledger
)
SELECT CASE WHEN u = 0 THEN u + a ELSE u END AS tile_count, a AS anomalies_detected, u + a AS total_records,
  CASE WHEN lo IS NULL THEN 'No data ingested yet' WHEN lo = hi THEN lo ELSE lo || ' to ' || hi END AS date_range, array_to_string(s, ',') AS sensors FROM c""",
    ("audit_changes",),
)
def ingest_status(d: Data):
    return ledger.ingest_status(ledger_now(d)).withColumn("sensors", F.concat_ws(",", "sensors"))


@query(
    "anomalous_tiles",
    LEDGER
    + """
SELECT id, primary_tag, round(anomaly_score, 6) AS anomaly_score FROM ledger WHERE primary_tag <> 'unassigned' OR anomaly_score > 0
ORDER BY ledger.anomaly_score DESC, created_at DESC, id LIMIT 50""",
    ("audit_changes",),
)
def anomalous_tiles(d: Data):
    return ledger.anomalous_tiles(ledger_now(d)).select("id", "primary_tag", r6("anomaly_score"))


# -- hotspots ------------------------------------------------------------------

HALVES = """
, halves AS (
  SELECT l.id, h.part, h.tile_id FROM pair_ledger l, LATERAL (
    SELECT unnest(string_split(l.id, '__')) AS tile_id, unnest(range(len(string_split(l.id, '__')))) AS part) h
), payload AS (
  SELECT h.id, h.part, t.* EXCLUDE (label) FROM halves h JOIN located t ON t.tile_id = h.tile_id
  QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY part) = 1
)
"""


def payload(d: Data):
    spots = d.tile_points.select("point_id", "tile_id", "bounds", "crs", "sensor", "date")
    ratios = cloud_ratio(d.view("pixels_grey"), ["tile_id"], F.col("level")).withColumnRenamed("cloud_ratio", "cloud")
    return spots.join(ratios, "tile_id").withColumn("cloud_cover", F.lit(None).cast("double"))


@query(
    "hotspot_payload_join",
    UTM_SQL
    + HALVES
    + "SELECT l.id, coalesce(p.tile_id, 'none') AS payload_tile, CAST(coalesce(p.part, -1) AS INT) AS part FROM pair_ledger l LEFT JOIN payload p ON p.id = l.id",
    ("tile_points", "pair_ledger"),
)
def hotspot_payload_join(d: Data):
    joined = hotspots.hotspot_payload_join(d.view("pair_ledger"), d.tile_points.select("point_id", "tile_id"))
    return joined.select(
        "id", F.coalesce("p_tile_id", F.lit("none")).alias("payload_tile"), F.coalesce("part", F.lit(-1)).alias("part")
    )


@query(
    "hotspot_list",
    UTM_SQL
    + HALVES
    + r""", ratios AS (
  SELECT tile_id, avg(CASE WHEN level >= 0.82 OR level <= 0.08 THEN 1.0 ELSE 0.0 END) AS cloud FROM pixels_grey GROUP BY tile_id
), top AS (
  SELECT * FROM pair_ledger WHERE primary_tag <> 'unassigned' OR anomaly_score > 0 ORDER BY anomaly_score DESC, created_at DESC, id LIMIT 100
)
SELECT l.id, round(coalesce(p.lat, 19.28 - (CAST(regexp_extract(l.id, '_r(\d+)_c(\d+)', 1) AS INT) + 128) / 1024 * 0.43), 5) AS lat,
  round(coalesce(p.lng, 72.72 + (CAST(regexp_extract(l.id, '_r(\d+)_c(\d+)', 2) AS INT) + 128) / 1024 * 0.33), 5) AS lng,
  coalesce(nullif(primary_tag, ''), 'unassigned') AS classification, round(greatest(0, least(1, anomaly_score)), 6) AS confidence,
  coalesce(nullif(l.sensor, ''), nullif(p.sensor, ''), 'Sentinel-2') AS sensor,
  coalesce(nullif(l.date, ''), nullif(p.date, ''), '') AS date,
  CAST(coalesce(nullif(l.cloud_cover, 0), round_even(r.cloud * 100, 0), 5) AS INT) AS cloud_cover, status,
  coalesce(nullif(before_desc, ''), 'none') AS before_desc
FROM top l LEFT JOIN payload p ON p.id = l.id LEFT JOIN ratios r ON r.tile_id = p.tile_id""",
    ("tile_points", "pair_ledger", "pixels_grey"),
)
def hotspot_list(d: Data):
    listed = hotspots.hotspot_list(d.view("pair_ledger"), payload(d), EXTENT)
    return listed.select(
        "id",
        F.round("lat", 5).alias("lat"),
        F.round("lng", 5).alias("lng"),
        "classification",
        r6("confidence"),
        "sensor",
        "date",
        "cloud_cover",
        "status",
        F.coalesce("before_desc", F.lit("none")).alias("before_desc"),
    )


DECISIONS = "SELECT id, CASE WHEN cell % 3 = 0 THEN 'Accepted' WHEN cell % 3 = 1 THEN 'reject' ELSE 'watch' END AS new_status FROM {pair_ledger} WHERE status = 'pending'"


@query(
    "hotspot_decide",
    f"""
WITH dec AS ({DECISIONS.format(pair_ledger="pair_ledger")}), firsts AS (
  SELECT tile_id, min(id) AS id FROM pair_reviews GROUP BY tile_id
)
SELECT 'ledger' AS source, l.id AS tile_id, coalesce(dec.new_status, l.status) AS status, 'none' AS remarks FROM pair_ledger l LEFT JOIN dec USING (id)
UNION ALL
SELECT 'queue', q.tile_id, CASE WHEN dec.id IS NULL THEN q.status WHEN lower(new_status) = 'accepted' THEN 'CONFIRMED'
    WHEN lower(new_status) = 'reject' THEN 'REJECTED' ELSE 'PENDING' END,
  CASE WHEN dec.id IS NULL THEN coalesce(q.remarks, 'none') ELSE 'Analyst triage decision: ' || new_status END
FROM pair_reviews q LEFT JOIN firsts f ON f.id = q.id LEFT JOIN dec ON dec.id = f.tile_id""",
    ("pair_ledger", "pair_reviews"),
)
def hotspot_decide(d: Data):
    decisions = d.sql(DECISIONS, "pair_ledger")
    audit, queue = hotspots.hotspot_decide(d.view("pair_ledger"), d.view("pair_reviews"), decisions)
    left = audit.select(F.lit("ledger").alias("source"), F.col("id").alias("tile_id"), "status", F.lit("none").alias("remarks"))
    return left.unionByName(
        queue.select(F.lit("queue").alias("source"), "tile_id", "status", F.coalesce("remarks", F.lit("none")).alias("remarks"))
    )


@query(
    "hotspot_factors",
    """
WITH top AS (
  SELECT * FROM pair_ledger WHERE primary_tag <> 'unassigned' OR anomaly_score > 0 ORDER BY anomaly_score DESC, created_at DESC, id LIMIT 100
)
SELECT t.id, round(coalesce(r.drift_score, greatest(0, least(1, anomaly_score)) * 0.25), 6) AS drift,
  round(1 - coalesce(r.drift_score, greatest(0, least(1, anomaly_score)) * 0.25), 6) AS similarity FROM top t LEFT JOIN pair_reviews r ON r.tile_id = t.id""",
    ("pair_ledger", "pair_reviews"),
)
def hotspot_factors(d: Data):
    listed = hotspots.hotspot_list(d.view("pair_ledger"), payload(d), EXTENT)
    return hotspots.with_factors(listed, d.view("pair_reviews")).select("id", r6("drift"), r6("similarity"))


# -- provenance ----------------------------------------------------------------


def documents(d: Data):
    quality = cloud_ratio(d.view("pixels_grey"), ["tile_id"], F.col("level")).withColumnRenamed("cloud_ratio", "cloud")
    names = [f"{n}_{s}" for n in ("ndvi", "ndbi", "ndwi") for s in ("t1", "t2", "change")]
    # Index means by tile, keyed to the second date's tile ids.
    indexed = spectral.index_change(d.view("pixels_ms"), ["tile"])
    keyed = d.tiles.filter("scene_no = 2").select("tile_id", (F.col("cell") + 1).alias("tile"))
    tile_index = keyed.join(indexed, "tile").select("tile_id", *names)
    queue, audit = d.view("pair_reviews"), d.view("pair_ledger")
    items = queue.unionByName(provenance.audit_items(audit, queue))
    return provenance.provenance_doc(items, audit, quality, tile_index, D1, D3, F.lit("2025-03-01T00:00:00Z"))


PROVENANCE = """
WITH ratios AS (
  SELECT tile_id, avg(CASE WHEN level >= 0.82 OR level <= 0.08 THEN 1.0 ELSE 0.0 END) AS cloud FROM pixels_grey GROUP BY tile_id
), nd AS (
  SELECT tile, round(avg((b08 - b04) / (b08 + b04 + 1e-6)) FILTER (WHERE t = 2) - avg((b08 - b04) / (b08 + b04 + 1e-6)) FILTER (WHERE t = 1), 4) AS ndvi_change
  FROM pixels_ms GROUP BY tile
), items AS (
  SELECT id, tile_id, t1_tile_id, t2_tile_id, status, confidence, drift_score, remarks, date_t1, date_t2, CAST(id AS DOUBLE) AS left_x FROM pair_reviews
  UNION ALL
  SELECT NULL, id, CASE WHEN contains(id, '__') THEN split_part(id, '__', 1) ELSE id || '_t1' END,
    CASE WHEN contains(id, '__') THEN split_part(id, '__', 2) ELSE id || '_t2' END, upper(status), anomaly_score, anomaly_score, NULL, date, NULL, NULL
  FROM pair_ledger WHERE id NOT IN (SELECT tile_id FROM pair_reviews)
), docs AS (
  SELECT q.id, q.tile_id, q.t1_tile_id, q.t2_tile_id, coalesce(l.sensor, CASE WHEN l.id IS NULL THEN 'Sentinel-2 (MSI L2A)' END, 'none') AS sensor,
    abs(date_diff('day', CAST(coalesce(q.date_t1, '2023-12-08') AS DATE), CAST(coalesce(q.date_t2, '2024-12-17') AS DATE))) AS days_between,
    round(coalesce(drift_score, 0), 4) AS drift, round(confidence, 4) AS confidence, coalesce(round(c1.cloud, 6), -1) AS cloud_t1, coalesce(round(c2.cloud, 6), -1) AS cloud_t2,
    CASE q.status WHEN 'CONFIRMED' THEN 'accept' WHEN 'FLAGGED' THEN 'flag' WHEN 'PENDING' THEN 'pending' ELSE lower(q.status) END AS decision,
    q.status IN ('CONFIRMED', 'REJECTED') AS verified, coalesce(left_x, -1) AS left_x, coalesce(nd.ndvi_change, -9) AS ndvi_change, q.remarks
  FROM items q LEFT JOIN pair_ledger l ON l.id = q.tile_id
  LEFT JOIN ratios c1 ON c1.tile_id = q.t1_tile_id LEFT JOIN ratios c2 ON c2.tile_id = q.t2_tile_id
  LEFT JOIN tiles t ON t.tile_id = q.t2_tile_id LEFT JOIN nd ON nd.tile = t.cell + 1
)
"""
PROVENANCE_VIEWS = ("pixels_grey", "pixels_ms", "pair_reviews")


@query(
    "provenance_doc",
    PROVENANCE
    + """
SELECT coalesce(id, -1) AS id, tile_id, t1_tile_id, t2_tile_id, sensor, days_between, drift, confidence, cloud_t1, cloud_t2, decision, verified, left_x, ndvi_change,
  coalesce(remarks, 'Triage status: ' || decision) AS remarks FROM docs""",
    PROVENANCE_VIEWS,
)
def provenance_doc(d: Data):
    doc = documents(d)
    return doc.select(
        F.coalesce("id", F.lit(-1)).alias("id"),
        "tile_id",
        F.col("doc.source_scenes.t1_tile_id"),
        F.col("doc.source_scenes.t2_tile_id"),
        F.coalesce("doc.source_scenes.sensor", F.lit("none")).alias("sensor"),
        F.col("doc.source_scenes.acquisition_dates.temporal_interval_days").cast("long").alias("days_between"),
        F.col("doc.metrics_and_classification.drift_score").alias("drift"),
        F.col("doc.metrics_and_classification.rf_confidence_score").alias("confidence"),
        *[
            F.coalesce(r6(f"doc.processing_steps.cloud_shadow_masking.cloud_shadow_masking_ratio_{t}"), F.lit(-1.0)).alias(f"cloud_{t}")
            for t in ("t1", "t2")
        ],
        F.col("doc.analyst_review.decision_display").alias("decision"),
        F.col("doc.analyst_review.verified_by_analyst").alias("verified"),
        F.coalesce(F.col("doc.source_scenes.bounding_box.bounds")[0], F.lit(-1.0)).alias("left_x"),
        F.coalesce("doc.spectral_indices.ndvi.change", F.lit(-9.0)).alias("ndvi_change"),
        F.col("doc.analyst_review.remarks").alias("remarks"),
    )


@query(
    "provenance_export",
    PROVENANCE
    + """
SELECT coalesce(id, -1) AS id, 'provenance_hotspot_' || coalesce(CAST(id AS STRING), 'rec') || '_' || substring(regexp_replace(tile_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 32) || '.json' AS file_name,
  decision, drift, days_between FROM docs""",
    PROVENANCE_VIEWS,
)
def provenance_export(d: Data):
    exports = provenance.provenance_export(documents(d))
    return exports.select(
        F.coalesce("id", F.lit(-1)).alias("id"),
        "file_name",
        F.get_json_object("json", "$.analyst_review.decision_display").alias("decision"),
        F.get_json_object("json", "$.metrics_and_classification.drift_score").cast("double").alias("drift"),
        F.get_json_object("json", "$.source_scenes.acquisition_dates.temporal_interval_days").cast("long").alias("days_between"),
    )


@query("provenance_files", REGISTRY["provenance_export"].sql)
def provenance_files(d: Data):
    """The same from the written files: one per document, read back under their names."""
    exports = provenance.provenance_export(documents(d))
    folder = f"{shared_folder(d.spark).rstrip('/')}/documents/{uuid.uuid4().hex}"
    write_documents(exports, folder, shards=1)
    files = d.spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    field = lambda path: F.get_json_object("value", path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    number = F.regexp_extract(name, "^provenance_hotspot_([0-9]+)_", 1)
    return files.select(
        F.when(number != "", number.cast("long")).otherwise(F.lit(-1)).alias("id"),
        F.regexp_replace(name, f"_[0-9a-f]{{{HASH_CHARS}}}[.]json$", ".json").alias("file_name"),
        field("$.analyst_review.decision_display").alias("decision"),
        field("$.metrics_and_classification.drift_score").cast("double").alias("drift"),
        field("$.source_scenes.acquisition_dates.temporal_interval_days").cast("long").alias("days_between"),
    )


# The same updates through a stored table in buckets: rows before, then the update as a commit of its own.


def bucket_store(d: Data, **keys: str) -> BucketStore:
    return BucketStore(d.spark, f"{shared_folder(d.spark).rstrip('/')}/store/{uuid.uuid4().hex}", keys, buckets=8)


@query("audit_upsert_store", REGISTRY["audit_upsert"].sql)
def audit_upsert_store(d: Data):
    store = bucket_store(d, ledger="id")
    feed = d.view("audit_changes")
    for part in (feed.filter(F.col("ts") < CUT), feed.filter(F.col("ts") >= CUT)):
        store.merge(
            "ledger", part, lambda old, new: ledger.reduce_feed(new, ORDER) if old is None else ledger.audit_upsert(old, new, ORDER)
        )
    return store.read("ledger").select(
        "id",
        "image_path",
        "primary_tag",
        "cluster",
        r6("anomaly_score"),
        "status",
        F.coalesce("before_desc", F.lit("")).alias("before_desc"),
        F.coalesce("sensor", F.lit("none")).alias("sensor"),
        F.coalesce("date", F.lit("none")).alias("date"),
        text_of("created_at").alias("created_at"),
    )


@query("review_update_store", REGISTRY["review_update"].sql)
def review_update_store(d: Data):
    store = bucket_store(d, queue="id")
    with store.transaction() as t:
        t.upsert("queue", d.view("review_queue"))
    asked = d.sql(UPDATES, "events").filter(
        F.coalesce("new_status", F.col("new_confidence").cast("string"), "new_remarks").isNotNull()
    )
    store.merge("queue", asked, lambda old, new: review.review_update(old, new, now()))
    return store.read("queue").select(
        "id", "status", F.round("confidence", 9).alias("confidence"), F.coalesce("remarks", F.lit("none")).alias("remarks"), text_of("updated_at").alias("updated_at")
    )


@query("review_append_store", REGISTRY["review_append"].sql)
def review_append_store(d: Data):
    store = bucket_store(d, queue="id")
    with store.transaction() as t:
        t.upsert("queue", d.view("review_queue"))
    rows = d.view("pair_ledger").select(
        F.col("id").alias("tile_id"), "t1_tile_id", "t2_tile_id", F.lit("PENDING").alias("status"), F.col("anomaly_score").alias("confidence")
    )
    with store.transaction() as t:
        t.upsert("queue", review.numbered_rows(store.read("queue"), rows, ["t1_tile_id", "t2_tile_id"], now()))
    queue = store.read("queue")
    return queue.select("id", "tile_id", "status", F.round("confidence", 9).alias("confidence"), text_of("created_at").alias("created_at"))


@query("hotspot_decide_store", REGISTRY["hotspot_decide"].sql)
def hotspot_decide_store(d: Data):
    store = bucket_store(d, ledger="id", queue="id")
    with store.transaction() as t:
        t.upsert("ledger", d.view("pair_ledger"))
        t.upsert("queue", d.view("pair_reviews"))
    decisions = d.sql(DECISIONS, "pair_ledger")
    with store.transaction() as t:
        mirror = hotspots.mirrored_rows(t.read("ledger"), t.read("queue"), decisions)
        t.merge("ledger", decisions, ledger.status_update)
        t.merge("queue", mirror, hotspots.mirror_decisions)
    left = store.read("ledger").select(F.lit("ledger").alias("source"), F.col("id").alias("tile_id"), "status", F.lit("none").alias("remarks"))
    return left.unionByName(
        store.read("queue").select(F.lit("queue").alias("source"), "tile_id", "status", F.coalesce("remarks", F.lit("none")).alias("remarks"))
    )


@query(
    "record_fuzzy_match_table",
    """
WITH asked AS (
  SELECT DISTINCT tile_id AS wanted FROM review_queue
  UNION SELECT 'tile ' || tile_id || ' of the queue' FROM review_queue WHERE id % 100 = 0
  UNION SELECT CAST(id AS VARCHAR) FROM review_queue WHERE id % 100 = 0
)
SELECT wanted, id, tile_id, CASE WHEN CAST(id AS VARCHAR) = wanted THEN 0 WHEN tile_id = wanted THEN 1 ELSE 2 END AS match_grade
FROM asked JOIN review_queue ON CAST(id AS VARCHAR) = wanted OR contains(tile_id, wanted) OR contains(wanted, tile_id)
QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY match_grade, created_at DESC, id DESC) <= 2""",
    ("review_queue",),
)
def record_fuzzy_match_table(d: Data):
    queue = d.view("review_queue")
    tiles = queue.select(F.col("tile_id").alias("wanted"))
    some = queue.filter("id % 100 = 0")
    longer = some.select(F.concat(F.lit("tile "), "tile_id", F.lit(" of the queue")).alias("wanted"))
    numbers = some.select(F.col("id").cast("string").alias("wanted"))
    found = containment.records_of_requests(queue, tiles.union(longer).union(numbers), 2)
    return found.select("wanted", "id", "tile_id", "match_grade")
