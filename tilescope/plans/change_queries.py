"""Queries for pairing, scoring and dating change."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilescope.config import ChangeRules
from tilescope.functions import identity, vectors
from tilescope.operators import change, matching, quality
from tilescope.plans.registry import D1, D3, DATES, REGISTRY, Data, query, r6
from tilescope.session import shared_folder
from tilescope.streaming import arrivals


RULES = ChangeRules(drift_threshold=1.0, confidence_threshold=0.9, calibration=1.2, top_k=50)


def measured_points(d: Data):
    """Stored points with the cloud ratio measured on their pixels."""
    ratios = quality.cloud_ratio(d.view("pixels_grey"), ["tile_id"], F.col("level"))
    return d.points.drop("cloud").join(ratios.withColumnRenamed("cloud_ratio", "cloud"), "tile_id")


# DuckDB: points of the area with measured cloud, one per cell and date.
MEASURED = """
WITH ratios AS (
  SELECT tile_id, avg(CASE WHEN level >= 0.82 OR level <= 0.08 THEN 1.0 ELSE 0.0 END) AS cloud FROM pixels_grey GROUP BY tile_id
), pts AS (
  SELECT p.point_id, p.tile_id, p.date, p.sensor, p.cell, p.tile_row, p.tile_col, CAST(p.embedding AS DOUBLE[]) AS v, r.cloud
  FROM points p JOIN ratios r USING (tile_id)
), one AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY cell, date ORDER BY point_id) = 1)
"""
# DuckDB: scoring of rows with (v1, c1, date1) and (v2, c2, date2).
SCORING = """
  CASE WHEN c1 > 0.15 THEN 'T1 cloud/shadow contamination' WHEN c2 > 0.15 THEN 'T2 cloud/shadow contamination' END AS reason,
  c1 > 0.15 OR c2 > 0.15 AS suppressed,
  CASE WHEN c1 > 0.15 OR c2 > 0.15 THEN 1.0 ELSE list_cosine_similarity(v1, v2) END AS similarity,
  CASE WHEN c1 > 0.15 OR c2 > 0.15 THEN 0.0 ELSE greatest(0, 1 - list_cosine_similarity(v1, v2)) END AS drift,
  greatest(0, 1 - list_dot_product(v1, v2)) AS raw_drift
"""


@query(
    "tile_pair_join",
    """
WITH second AS (
  SELECT * FROM points WHERE date = '2024-12-17' AND (sensor = 'Landsat 8' OR NOT EXISTS (
    SELECT 1 FROM points WHERE date = '2024-12-17' AND sensor = 'Landsat 8'))
  QUALIFY row_number() OVER (PARTITION BY tile_row, tile_col ORDER BY point_id) = 1
)
SELECT a.point_id AS point_id_t1, b.point_id AS point_id_t2, a.tile_id AS t1_tile_id, b.tile_id AS t2_tile_id, a.tile_row, a.tile_col
FROM points a JOIN second b USING (tile_row, tile_col) WHERE a.date = '2023-12-08'""",
    ("points",),
)
def tile_pair_join(d: Data):
    pairs = change.tile_pair_join(d.points, D1, D3, "Landsat 8", ["point_id"])
    return pairs.select("point_id_t1", "point_id_t2", "t1_tile_id", "t2_tile_id", "tile_row", "tile_col")


@query(
    "scene_sequence",
    """
SELECT scene_id, date, sensor FROM scenes WHERE date IN ('2023-12-08', '2024-12-17') OR (date > '2023-12-08' AND date < '2024-12-17')""",
    ("scenes",),
)
def scene_sequence(d: Data):
    return change.scene_sequence(d.scenes, D1, D3).select("scene_id", "date", "sensor")


@query(
    "scene_interval_pairs",
    """
SELECT t1_tile_id, t2_tile_id, step FROM (
  SELECT tile_id AS t1_tile_id, lead(tile_id) OVER w AS t2_tile_id, row_number() OVER w AS step FROM (
    SELECT * FROM points WHERE date >= '2023-12-08' QUALIFY row_number() OVER (PARTITION BY cell, date ORDER BY point_id) = 1)
  WINDOW w AS (PARTITION BY cell ORDER BY date)) WHERE t2_tile_id IS NOT NULL""",
    ("points",),
)
def scene_interval_pairs(d: Data):
    pairs = change.scene_interval_pairs(change.dated_cells(d.points, DATES), ["date"])
    return pairs.select("t1_tile_id", "t2_tile_id", F.col("step").cast("long").alias("step"))


@query(
    "date_features",
    """
SELECT event_id, coalesce(abs(date_diff('day', b, a)), 30) AS days_between, coalesce(month(a), 1) AS month_t1, coalesce(month(b), 1) AS month_t2
FROM (SELECT event_id, try_cast(date AS DATE) AS a, DATE '2024-12-17' AS b FROM audit_changes)""",
    ("audit_changes",),
)
def date_features(d: Data):
    days, first, second = identity.date_features(F.col("date"), F.lit("2024-12-17T10:00:00"))
    named = {"days_between": days, "month_t1": first, "month_t2": second}
    return d.view("audit_changes").select("event_id", *[c.cast("long").alias(n) for n, c in named.items()])


@query(
    "hist_match",
    """
WITH px AS (
  SELECT cell, scene_no AS pair, 1 AS side, level FROM pixels_grey UNION ALL SELECT cell, scene_no - 1, 2, level FROM pixels_grey
), tally AS (SELECT cell, pair, side, level, count(*) AS n FROM px GROUP BY ALL
), curve AS (
  SELECT *, sum(n) OVER (PARTITION BY cell, pair, side ORDER BY level) / sum(n) OVER (PARTITION BY cell, pair, side) AS q FROM tally
), found AS (
  SELECT s.cell, s.pair, s.level AS source_value, s.n, s.q,
    (SELECT max(t.level) FROM curve t WHERE t.cell = s.cell AND t.pair = s.pair AND t.side = 1 AND t.q <= s.q) AS v0,
    (SELECT max(t.q) FROM curve t WHERE t.cell = s.cell AND t.pair = s.pair AND t.side = 1 AND t.q <= s.q) AS q0,
    (SELECT min(t.level) FROM curve t WHERE t.cell = s.cell AND t.pair = s.pair AND t.side = 1 AND t.q >= s.q) AS v1,
    (SELECT min(t.q) FROM curve t WHERE t.cell = s.cell AND t.pair = s.pair AND t.side = 1 AND t.q >= s.q) AS q1
  FROM curve s WHERE s.side = 2
)
SELECT cell, CAST(pair AS BIGINT) AS pair, round(source_value, 6) AS source_value, CAST(n AS BIGINT) AS n,
  round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q1 = q0 THEN v0 ELSE v0 + (v1 - v0) * (q - q0) / (q1 - q0) END, 6) AS matched_value
FROM found WHERE v0 IS NOT NULL OR v1 IS NOT NULL""",
    ("pixels_grey",),
)
def hist_match(d: Data):
    pixels = d.view("pixels_grey")
    # A date is the first of its own pair and the second of the one before.
    first = pixels.withColumn("pair", F.col("scene_no").cast("long")).withColumn("side", F.lit(1))
    second = pixels.withColumn("pair", F.col("scene_no").cast("long") - 1).withColumn("side", F.lit(2))
    table = matching.match_table(first.unionByName(second), ["cell", "pair"], "side", "level")
    return table.filter("matched_value IS NOT NULL").select("cell", "pair", r6("source_value"), "n", r6("matched_value"))


@query(
    "cloud_suppress",
    MEASURED
    + """
SELECT a.cell, CASE WHEN a.cloud > 0.15 THEN 'T1 cloud/shadow contamination' WHEN b.cloud > 0.15 THEN 'T2 cloud/shadow contamination'
  ELSE 'none' END AS reason FROM one a JOIN one b ON a.cell = b.cell AND a.date = '2023-12-08' AND b.date = '2024-12-17'""",
    ("points", "pixels_grey"),
)
def cloud_suppress(d: Data):
    pairs = change.tile_pair_join(measured_points(d), D1, D3, None, ["cloud", "cell", "point_id"])
    first = change.top_per_key(pairs, ["cell_t1"], [F.col("point_id_t1")])
    reason = quality.suppression_reason(F.col("cloud_t1"), F.col("cloud_t2"))
    return first.select(F.col("cell_t1").alias("cell"), F.coalesce(reason, F.lit("none")).alias("reason"))


PAIR_SQL = (
    MEASURED
    + """, pairs AS (
  SELECT a.cell, a.tile_id AS t1_tile_id, b.tile_id AS t2_tile_id, a.v AS v1, b.v AS v2, a.cloud AS c1, b.cloud AS c2
  FROM one a JOIN one b ON a.cell = b.cell AND a.date = '2023-12-08' AND b.date = '2024-12-17'
), scored AS (SELECT *, """
    + SCORING
    + " FROM pairs)"
)


def scored_pairs(d: Data):
    unique = change.dated_cells(measured_points(d), DATES)
    pairs = change.tile_pair_join(unique, D1, D3, None, ["embedding", "cloud", "date"])
    return change.change_pair_score(pairs, RULES.calibration)


@query(
    "change_pair_score",
    PAIR_SQL
    + """
SELECT t1_tile_id, t2_tile_id, suppressed, coalesce(reason, 'none') AS reason, round(similarity, 6) AS similarity, round(drift, 6) AS drift,
  round(raw_drift, 6) AS raw_drift, round(least(1, drift / 1.2), 6) AS confidence, 375 AS days_between, 12 AS month_t1, 12 AS month_t2
FROM scored""",
    ("points", "pixels_grey"),
)
def change_pair_score(d: Data):
    return scored_pairs(d).select(
        "t1_tile_id",
        "t2_tile_id",
        "suppressed",
        F.coalesce("reason", F.lit("none")).alias("reason"),
        r6("similarity"),
        r6("drift"),
        r6("raw_drift"),
        r6("confidence"),
        "days_between",
        "month_t1",
        "month_t2",
    )


@query(
    "confidence_fallback",
    PAIR_SQL + "SELECT t1_tile_id, round(least(1, greatest(0, 1 - list_cosine_similarity(v1, v2)) / 0.25), 6) AS confidence FROM pairs",
    ("points", "pixels_grey"),
)
def confidence_fallback(d: Data):
    pairs = scored_pairs(d)
    # raw_drift equals drift for unit vectors and is not affected by suppression.
    return pairs.select("t1_tile_id", r6(change.confidence_fallback(F.col("raw_drift")), "confidence"))


@query(
    "confidence_factors",
    PAIR_SQL
    + """
SELECT t1_tile_id, f.* FROM (SELECT t1_tile_id, CASE WHEN NOT suppressed THEN {
  'drift': round(drift, 4), 'similarity': round(similarity, 4), 'cloud_contamination_ratio_t1': round(c1, 4),
  'cloud_contamination_ratio_t2': round(c2, 4), 'days_between': 375, 'month_t1': 12, 'month_t2': 12,
  'radiometric_normalization': CAST(NULL AS VARCHAR), 'spatial_alignment': CAST(NULL AS VARCHAR),
  'rf_model': 'Deterministic Calibration'} END AS f FROM scored)""",
    ("points", "pixels_grey"),
)
def confidence_factors(d: Data):
    scored = scored_pairs(d)
    return scored.select("t1_tile_id", change.confidence_factors(scored).alias("f")).select("t1_tile_id", "f.*")


INTERVALS = (
    MEASURED
    + """, steps AS (
  SELECT cell, tile_id AS t1_tile_id, date AS date1, v AS v1, cloud AS c1, lead(tile_id) OVER w AS t2_tile_id, lead(date) OVER w AS date2,
    lead(v) OVER w AS v2, lead(cloud) OVER w AS c2, row_number() OVER w AS step
  FROM one WHERE date >= '2023-12-08' WINDOW w AS (PARTITION BY cell ORDER BY date)
), scored AS (SELECT *, """
    + SCORING
    + """ FROM steps WHERE t2_tile_id IS NOT NULL
), judged AS (
  SELECT *, least(1, drift / 1.2) AS confidence, NOT suppressed AND round(least(1, drift / 1.2), 4) >= 0.9 AS crossed FROM scored
), ends AS (
  SELECT cell, count(*) AS n_dates, arg_min(tile_id, date) AS t1_tile_id, arg_max(tile_id, date) AS t2_tile_id, min(date) AS date1,
    max(date) AS date2, arg_min(v, date) AS v1, arg_max(v, date) AS v2, arg_min(cloud, date) AS c1, arg_max(cloud, date) AS c2
  FROM one WHERE date >= '2023-12-08' GROUP BY cell
), span AS (SELECT *, """
    + SCORING
    + """ FROM ends
), history AS (
  SELECT s.cell, s.t1_tile_id, s.t2_tile_id, s.date1, s.date2, s.drift, s.similarity, s.suppressed, s.n_dates, least(1, s.drift / 1.2) AS confidence,
    coalesce(f.first_crossing, CASE WHEN s.n_dates > 2 AND NOT s.suppressed AND least(1, s.drift / 1.2) >= 0.9 THEN s.date2 END) AS earliest_change,
    coalesce(f.n_intervals, 0) AS n_intervals
  FROM span s LEFT JOIN (
    SELECT cell, min(date2) FILTER (WHERE crossed) AS first_crossing, count(*) AS n_intervals FROM judged GROUP BY cell) f USING (cell)
)
"""
)


@query(
    "pairwise_intervals",
    INTERVALS
    + """
SELECT t1_tile_id, t2_tile_id, step, date1 AS date_from, date2 AS date_to, suppressed, coalesce(reason, 'none') AS reason,
  round(drift, 6) AS drift, round(raw_drift, 6) AS raw_drift, round(confidence, 6) AS confidence, crossed AS threshold_crossed FROM judged""",
    ("points", "pixels_grey"),
)
def pairwise_intervals(d: Data):
    rows = change.pairwise_intervals(change.dated_cells(measured_points(d), DATES), RULES)
    return rows.select(
        "t1_tile_id",
        "t2_tile_id",
        F.col("step").cast("long").alias("step"),
        F.col("date_t1").alias("date_from"),
        F.col("date_t2").alias("date_to"),
        "suppressed",
        F.coalesce("reason", F.lit("none")).alias("reason"),
        r6("drift"),
        r6("raw_drift"),
        r6("confidence"),
        "threshold_crossed",
    )


@query(
    "matched_intervals",
    MEASURED
    + """, steps AS (
  SELECT cell, tile_id AS t1_tile_id, date AS date1, v AS v1, cloud AS c1, lead(tile_id) OVER w AS t2_tile_id, lead(date) OVER w AS date2,
    lead(v) OVER w AS v2, lead(cloud) OVER w AS c2 FROM one WINDOW w AS (PARTITION BY cell ORDER BY date)
), matched AS (
  SELECT *, CASE WHEN cell % 2 = 0 THEN list_transform(list_zip(v1, v2), lambda p: (p[1] + p[2]) / 2) ELSE v2 END AS m2
  FROM steps WHERE t2_tile_id IS NOT NULL
), scored AS (
  SELECT *, c1 > 0.15 OR c2 > 0.15 AS suppressed, greatest(0, 1 - list_dot_product(v1, v2)) AS raw_drift,
    CASE WHEN c1 > 0.15 OR c2 > 0.15 THEN 0.0 ELSE greatest(0, 1 - list_cosine_similarity(v1, m2)) END AS drift FROM matched
)
SELECT t1_tile_id, t2_tile_id, suppressed, round(drift, 6) AS drift, round(raw_drift, 6) AS raw_drift,
  round(least(1, drift / 1.2), 6) AS confidence FROM scored""",
    ("points", "pixels_grey"),
)
def matched_intervals(d: Data):
    """Every other cell has vectors of matched images, half way to the first; the rest fall back to the stored ones."""
    cells = change.dated_cells(measured_points(d), DATES)
    pairs = change.scene_interval_pairs(cells, ["embedding", "cell"]).filter(F.col("cell_t1") % 2 == 0)
    middle = F.zip_with(vectors.as_double(F.col("embedding_t1")), vectors.as_double(F.col("embedding_t2")), lambda a, b: (a + b) / 2)
    matched = pairs.select("t1_tile_id", "t2_tile_id", middle.alias("matched_t2"))
    rows = change.pairwise_intervals(cells, RULES, matched=matched)
    return rows.select("t1_tile_id", "t2_tile_id", "suppressed", r6("drift"), r6("raw_drift"), r6("confidence"))


@query(
    "earliest_change",
    INTERVALS + "SELECT cell, coalesce(earliest_change, 'never') AS earliest_change FROM history",
    ("points", "pixels_grey"),
)
def earliest_change(d: Data):
    history = change.cell_history(measured_points(d), DATES, None, RULES)
    cell = (F.col("tile_row") / 256 * 26 + F.col("tile_col") / 256).cast("long")
    return history.select(cell.alias("cell"), F.coalesce("earliest_change", F.lit("never")).alias("earliest_change"))


@query("earliest_change_stream", REGISTRY["earliest_change"].sql)
def earliest_change_stream(d: Data):
    """The same from a stream: scenes arrive newest first, so every further one splits or extends what is there."""
    points = measured_points(d).filter(F.col("date").isin(DATES))
    folder = f"{shared_folder(d.spark).rstrip('/')}/arrivals/{uuid.uuid4().hex}"
    store = arrivals.history_store(d.spark, f"{folder}/store", buckets=8)
    for date in sorted(DATES, reverse=True):
        points.filter(F.col("date") == date).write.mode("append").parquet(f"{folder}/in")
        stream = d.spark.readStream.schema(points.schema).parquet(f"{folder}/in")
        arrivals.keep_history(stream, store, f"{folder}/marks", RULES).awaitTermination()
    cell = (F.col("tile_row") / 256 * 26 + F.col("tile_col") / 256).cast("long")
    found = store.read(arrivals.TABLE)
    return found.select(cell.alias("cell"), F.coalesce("earliest_change", F.lit("never")).alias("earliest_change"))


CANDIDATES = (
    INTERVALS
    + """, found AS (
  SELECT * FROM history WHERE date1 = '2023-12-08' AND date2 = '2024-12-17' AND NOT suppressed AND drift >= 1.0
)
"""
)
CANDIDATE_COLUMNS = """
SELECT t1_tile_id, t2_tile_id, round(drift, 6) AS drift, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence,
  coalesce(earliest_change, 'never') AS earliest_change, n_intervals FROM found"""


def shown(candidates):
    return candidates.select(
        "t1_tile_id",
        "t2_tile_id",
        r6("drift"),
        r6("similarity"),
        r6("confidence"),
        F.coalesce("earliest_change", F.lit("never")).alias("earliest_change"),
        F.size("intervals").cast("long").alias("n_intervals"),
    )


@query("detect_scene_change", CANDIDATES + CANDIDATE_COLUMNS, ("points", "pixels_grey"))
def detect_scene_change(d: Data):
    return shown(change.detect_scene_change(measured_points(d), DATES, None, RULES, limit=False))


@query(
    "change_top_k",
    CANDIDATES + CANDIDATE_COLUMNS + " ORDER BY found.drift DESC, t1_tile_id LIMIT 50",
    ("points", "pixels_grey"),
)
def change_top_k(d: Data):
    return shown(change.detect_scene_change(measured_points(d), DATES, None, RULES))


@query(
    "detect_review_rows",
    CANDIDATES
    + """
SELECT t1_tile_id || '__' || t2_tile_id AS tile_id, 'PENDING' AS status, round(confidence, 6) AS confidence, round(drift, 6) AS drift_score,
  'Multi-temporal detection. Earliest change: ' || coalesce(earliest_change, 'None') AS remarks FROM found""",
    ("points", "pixels_grey"),
)
def detect_review_rows(d: Data):
    found = change.detect_scene_change(measured_points(d), DATES, None, RULES, limit=False)
    return change.review_rows(found).select("tile_id", "status", r6("confidence"), r6("drift_score"), "remarks")


@query(
    "detect_audit_rows",
    CANDIDATES
    + """
SELECT t1_tile_id || '__' || t2_tile_id AS id, 'detected-change' AS primary_tag, round(confidence, 6) AS anomaly_score,
  'Baseline observation from 2023-12-08 (Sentinel-2)' AS before_desc,
  'Spectral drift: ' || format('{{:.3f}}', drift) || ' observed on 2024-12-17' AS after_desc
FROM found ORDER BY found.drift DESC, t1_tile_id LIMIT 50""".replace("{{", "{").replace("}}", "}"),
    ("points", "pixels_grey"),
)
def detect_audit_rows(d: Data):
    found = change.detect_scene_change(measured_points(d), DATES, None, RULES)
    rows = change.audit_rows(found, "Sentinel-2")
    return rows.select("id", "primary_tag", r6("anomaly_score"), "before_desc", "after_desc")


@query(
    "describe_candidates",
    CANDIDATES.replace("s.n_dates, least(1", "s.n_dates, s.c1, s.c2, least(1")
    + """
SELECT t1_tile_id || '__' || t2_tile_id AS id, CAST(round_even(c2 * 100, 0) AS INT) AS cloud_cover,
  'Baseline observation from 2023-12-08 (Sentinel-2)' AS before_desc, round(c1, 4) AS cloud_ratio_t1, 375 AS days_between,
  'Deterministic Calibration' AS rf_model FROM found""",
    ("points", "pixels_grey"),
)
def describe_candidates(d: Data):
    found = change.detect_scene_change(measured_points(d), DATES, None, RULES, limit=False)
    told = change.describe_candidates(found, "Sentinel-2")
    return told.select(
        F.concat("t1_tile_id", F.lit("__"), "t2_tile_id").alias("id"),
        "cloud_cover",
        "before_desc",
        F.col("confidence_factors.cloud_contamination_ratio_t1").alias("cloud_ratio_t1"),
        F.col("confidence_factors.days_between"),
        F.col("confidence_factors.rf_model"),
    )


REVIEWED = """
, stored AS (
  SELECT h.*, coalesce(r0.id, r1.id, r2.id) AS review_id,
    CASE WHEN r0.id IS NOT NULL THEN r0.drift_score WHEN r1.id IS NOT NULL THEN r1.drift_score ELSE r2.drift_score END AS stored_drift,
    coalesce(r0.confidence, r1.confidence, r2.confidence) AS stored_confidence
  FROM history h LEFT JOIN pair_reviews r0 ON r0.tile_id = h.t1_tile_id || '__' || h.t2_tile_id
  LEFT JOIN pair_reviews r1 ON r1.tile_id = h.t2_tile_id LEFT JOIN pair_reviews r2 ON r2.tile_id = h.t1_tile_id
)
SELECT t1_tile_id, t2_tile_id, coalesce(review_id, -1) AS review_id,
  round(CASE WHEN review_id IS NULL THEN drift ELSE coalesce(stored_drift, 0) END, 6) AS drift,
  round(CASE WHEN review_id IS NULL THEN similarity ELSE 1 - coalesce(stored_drift, 0) END, 6) AS similarity,
  round(CASE WHEN review_id IS NULL THEN confidence ELSE stored_confidence END, 6) AS confidence,
  suppressed AND review_id IS NULL AS suppressed, coalesce(earliest_change, 'never') AS earliest_change FROM stored
"""


def reviewed(rows):
    return rows.select(
        "t1_tile_id",
        "t2_tile_id",
        F.coalesce("review_id", F.lit(-1)).alias("review_id"),
        r6("drift"),
        r6("similarity"),
        r6("confidence"),
        "suppressed",
        F.coalesce("earliest_change", F.lit("never")).alias("earliest_change"),
    )


@query("review_candidate_join", INTERVALS + REVIEWED, ("points", "pixels_grey", "pair_reviews"))
def review_candidate_join(d: Data):
    history = change.cell_history(measured_points(d), DATES, None, RULES)
    return reviewed(change.review_candidate_join(history, d.view("pair_reviews")))


ASKED_TILE = "aoi_2024-12-17_r0_c1024_2024-12-17"


@query(
    "detect_tile_change",
    INTERVALS + REVIEWED + f" WHERE t1_tile_id = '{ASKED_TILE}' OR t2_tile_id = '{ASKED_TILE}'",
    ("points", "pixels_grey", "pair_reviews"),
)
def detect_tile_change(d: Data):
    rows = change.detect_tile_change(measured_points(d), d.view("pair_reviews"), ASKED_TILE, DATES, RULES)
    return reviewed(rows)


@query(
    "ledger_consistency",
    INTERVALS
    + """
SELECT h.t1_tile_id || '__' || h.t2_tile_id AS tile_id, coalesce(abs(drift - drift_score) < 0.35 AND abs(h.confidence - r.confidence) < 0.35, false) AS consistent
FROM history h JOIN pair_reviews r ON r.tile_id = h.t1_tile_id || '__' || h.t2_tile_id""",
    ("points", "pixels_grey", "pair_reviews"),
)
def ledger_consistency(d: Data):
    history = change.cell_history(measured_points(d), DATES, None, RULES)
    named = history.withColumn("tile_id", F.concat("t1_tile_id", F.lit("__"), "t2_tile_id"))
    return change.ledger_consistency(named, d.view("pair_reviews"), 0.35).select("tile_id", "consistent")
