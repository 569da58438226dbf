"""Change between dates: pairing, scoring, intervals and the scene-wide plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope import config
from tilescope.config import ChangeRules
from tilescope.functions import identity, vectors
from tilescope.functions.ranking import top_per_key
from tilescope.operators.quality import suppression_reason

CELL = ["site", "tile_row", "tile_col"]


def scene_sequence(scenes: DataFrame, first: str, last: str) -> DataFrame:
    """The two end scenes and every scene strictly between them, by date."""
    inside = (F.col("date") > first) & (F.col("date") < last)
    return scenes.filter(F.col("date").isin(first, last) | inside).orderBy("date", "scene_id")


def prefer_sensor(tiles: DataFrame, date: str, sensor: str | None) -> Column:
    """Condition: the date's tiles of a sensor, or all of them when the sensor has none."""
    dated = F.col("date") == date
    if not sensor:
        return dated
    any_tile = tiles.filter(dated).agg(F.coalesce(F.max(F.col("sensor") == sensor), F.lit(False)).alias("any"))
    return dated & ((F.col("sensor") == sensor) | ~any_tile.scalar())


def tile_pair_join(tiles: DataFrame, date_t1: str, date_t2: str, sensor: str | None, carry: Sequence[str]) -> DataFrame:
    """T1 and T2 tiles of the same cell; the smallest T2 point id wins on repeats."""
    first = tiles.filter(F.col("date") == date_t1).select(
        *CELL, F.col("tile_id").alias("t1_tile_id"), *[F.col(c).alias(f"{c}_t1") for c in carry]
    )
    second = top_per_key(tiles.filter(prefer_sensor(tiles, date_t2, sensor)), CELL, [F.col("point_id")]).select(
        *CELL, F.col("tile_id").alias("t2_tile_id"), *[F.col(c).alias(f"{c}_t2") for c in carry]
    )
    return first.join(second, CELL)


def confidence_fallback(drift: Column, calibration: float = config.DRIFT_THRESHOLD) -> Column:
    return F.least(F.lit(1.0), drift / max(calibration, 1e-6))


def change_pair_score(
    pairs: DataFrame,
    calibration: float = config.DRIFT_THRESHOLD,
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    model: PipelineModel | None = None,
) -> DataFrame:
    """Score tile pairs that carry embedding, cloud and date on both sides.

    With a column matched_t2 (the second image's vector after its histograms
    were matched to the first) drift and similarity are taken from it, where it
    is there, and raw_drift from the stored vectors. With a forest the
    confidence is its probability of real change, else a ratio of the drift.
    Suppressed pairs get drift 0, similarity 1, confidence 0 and a reason. The
    vectors are consumed here and leave the plan.
    """
    matched = "matched_t2" in pairs.columns
    second = F.coalesce("matched_t2", "embedding_t2") if matched else F.col("embedding_t2")
    reason = suppression_reason(F.col("cloud_t1"), F.col("cloud_t2"), max_ratio)
    days, month_t1, month_t2 = identity.date_features(F.col("date_t1"), F.col("date_t2"))
    scored = (
        pairs.withColumn("reason", reason)
        .withColumn("suppressed", F.col("reason").isNotNull())
        .withColumn("dot", vectors.dot(F.col("embedding_t1"), F.col("embedding_t2")))
        .withColumn("cos", vectors.cosine(F.col("embedding_t1"), second, None if matched else F.col("dot")))
        .withColumn("raw_drift", vectors.drift(F.col("dot")))
        .drop("embedding_t1", "embedding_t2", "matched_t2", "dot")
    )
    rated = (
        scored.withColumn("similarity", F.when(F.col("suppressed"), F.lit(1.0)).otherwise(F.col("cos")))
        .withColumn("drift", F.when(F.col("suppressed"), F.lit(0.0)).otherwise(vectors.drift(F.col("cos"))))
        .withColumn("days_between", days)
        .withColumn("month_t1", month_t1)
        .withColumn("month_t2", month_t2)
        .drop("cos")
    )
    if model is None:
        sure = confidence_fallback(F.col("drift"), calibration)
    else:
        # A forest takes no nulls: a pair with an unmeasured input falls back too.
        known = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in config.CHANGE_FEATURES]
        rest = [c for c in rated.columns if c not in config.CHANGE_FEATURES]
        kept = F.struct(*config.CHANGE_FEATURES).alias("__in")
        whole = model.transform(rated.select(*rest, *known, kept))
        rated = whole.withColumn("__p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        rated = rated.withColumns({c: F.col(f"__in.{c}") for c in config.CHANGE_FEATURES})
        missing = F.exists(F.array(*[F.col(c).cast("double") for c in config.CHANGE_FEATURES]), lambda x: x.isNull())
        sure = F.when(missing, confidence_fallback(F.col("drift"), calibration)).otherwise(F.col("__p"))
    return rated.withColumn("confidence", F.when(F.col("suppressed"), F.lit(0.0)).otherwise(sure)).drop("__p", "__in")


def confidence_factors(
    scored: DataFrame, classifier: str = config.FALLBACK_LABEL, grid: str | None = None, radiometric: str | None = None
) -> Column:
    """The seven classifier inputs and their labels as one struct; null for suppressed pairs.

    `grid` and `radiometric` say how the images were aligned and matched, null if nobody knows.
    """
    factors = F.struct(
        F.round("drift", 4).alias("drift"),
        F.round("similarity", 4).alias("similarity"),
        F.round("cloud_t1", 4).alias("cloud_contamination_ratio_t1"),
        F.round("cloud_t2", 4).alias("cloud_contamination_ratio_t2"),
        F.col("days_between"),
        F.col("month_t1"),
        F.col("month_t2"),
        F.lit(radiometric).cast("string").alias("radiometric_normalization"),
        F.lit(grid).cast("string").alias("spatial_alignment"),
        F.lit(classifier).alias("rf_model"),
    )
    return F.when(~F.col("suppressed"), factors) if "suppressed" in scored.columns else factors


def dated_cells(tiles: DataFrame, dates: Sequence[str], sensor: str | None = None) -> DataFrame:
    """One tile per cell and date; the sensor preference applies to the last date."""
    wanted = F.col("date").isin(list(dates[:-1])) | prefer_sensor(tiles, dates[-1], sensor)
    return top_per_key(tiles.filter(wanted), [*CELL, "date"], [F.col("point_id")])


def _cell_window() -> Window:
    return Window.partitionBy(*CELL).orderBy("date")


def scene_interval_pairs(cells: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Each tile with the next one of its cell in date order (no self-join)."""
    window = _cell_window()
    later = [F.lead(c).over(window).alias(f"{c}_t2") for c in carry]
    return (
        cells.select(
            *CELL,
            F.col("tile_id").alias("t1_tile_id"),
            F.lead("tile_id").over(window).alias("t2_tile_id"),
            *[F.col(c).alias(f"{c}_t1") for c in carry],
            *later,
            F.row_number().over(window).alias("step"),
        )
        .filter(F.col("t2_tile_id").isNotNull())
    )


CARRY = ["embedding", "cloud", "date"]


def with_matched(pairs: DataFrame, matched: DataFrame | None) -> DataFrame:
    """Pairs with the second image's matched vector, where there is one."""
    if matched is None:
        return pairs
    return pairs.join(matched.select("t1_tile_id", "t2_tile_id", "matched_t2"), ["t1_tile_id", "t2_tile_id"], "left")


def pairwise_intervals(
    cells: DataFrame,
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    model: PipelineModel | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Scored consecutive intervals of every cell with the threshold test.

    `matched` is (t1_tile_id, t2_tile_id, matched_t2), see change_pair_score.
    """
    pairs = with_matched(scene_interval_pairs(cells, CARRY), matched)
    scored = change_pair_score(pairs, rules.calibration, max_ratio, model)
    crossed = ~F.col("suppressed") & (F.round("confidence", 4) >= rules.confidence_threshold)
    return scored.withColumn("threshold_crossed", crossed)


def cell_history(
    tiles: DataFrame,
    dates: Sequence[str],
    sensor: str | None = None,
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    need_ends: bool = False,
    model: PipelineModel | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Per cell: intervals, earliest change date, and the first-to-last pair.

    The whole history is one shuffle by cell. Repeats are settled inside it: the
    dates are a short fixed list, so each gets one slot that keeps the smallest
    point id, and that minimum combines before the shuffle. A cell stored a
    million times therefore leaves each task as one row. Exploding slots into
    pairs and collecting scored pairs again keeps the partitioning by cell.
    """
    wanted = F.col("date").isin(list(dates[:-1])) | prefer_sensor(tiles, dates[-1], sensor)
    record = F.struct("point_id", "tile_id", *CARRY)
    slots = [F.min(F.when(F.col("date") == d, record)).alias(f"slot_{i}") for i, d in enumerate(dates)]
    by_cell = tiles.filter(wanted).groupBy(*CELL).agg(*slots)
    if need_ends:
        by_cell = by_cell.filter(F.col("slot_0").isNotNull() & F.col(f"slot_{len(dates) - 1}").isNotNull())
    seen = F.filter(F.array(*[F.col(f"slot_{i}") for i in range(len(dates))]), lambda x: x.isNotNull())
    return history_of_seen(by_cell.select(*CELL, seen.alias("seen")), rules, max_ratio, model, matched)


def history_of_seen(
    cells: DataFrame,
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    model: PipelineModel | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """cell_history of cells that come with `seen`, one struct (point_id, tile_id, embedding, cloud, date) per date, in date order."""
    listed = cells.select(*CELL, "seen").withColumn("n_dates", F.size("seen"))

    # Steps 1..n-1 are the intervals; step n is the whole span.
    stepped = listed.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n_dates")))).withColumn(
        "is_span", F.col("step") == F.col("n_dates")
    )
    pairs = (
        stepped.withColumn("a", F.get("seen", F.when(F.col("is_span"), F.lit(0)).otherwise(F.col("step") - 1)))
        .withColumn("b", F.get("seen", F.when(F.col("is_span"), F.col("step") - 1).otherwise(F.col("step"))))
        .select(
            *CELL,
            "step",
            "is_span",
            F.col("a.tile_id").alias("t1_tile_id"),
            F.col("b.tile_id").alias("t2_tile_id"),
            *[F.col(f"a.{c}").alias(f"{c}_t1") for c in CARRY],
            *[F.col(f"b.{c}").alias(f"{c}_t2") for c in CARRY],
        )
    )
    scored = change_pair_score(with_matched(pairs, matched), rules.calibration, max_ratio, model)
    crossed = ~F.col("suppressed") & (F.round("confidence", 4) >= rules.confidence_threshold)
    scored = scored.withColumn("crossed", crossed)
    step = F.col("step")
    interval = F.struct(
        step.alias("step"),
        F.concat(F.col("date_t1"), F.lit(" -> "), F.col("date_t2")).alias("pair"),
        F.concat(F.lit("T"), step.cast("string"), F.lit("->T"), (step + 1).cast("string")).alias("interval"),
        F.col("date_t1").alias("date_from"),
        F.col("date_t2").alias("date_to"),
        F.round("drift", 4).alias("drift"),
        F.round("similarity", 4).alias("similarity"),
        F.round("confidence", 4).alias("confidence"),
        "suppressed",
        F.col("reason").alias("suppression_reason"),
        F.round("raw_drift", 6).alias("raw_drift"),
        F.col("crossed").alias("threshold_crossed"),
    )
    span_fields = [
        "t1_tile_id", "t2_tile_id", "drift", "similarity", "confidence", "suppressed", "reason", "raw_drift",
        "cloud_t1", "cloud_t2", "date_t1", "date_t2", "days_between", "month_t1", "month_t2",
    ]
    span = F.col("is_span")
    return (
        scored.groupBy(*CELL)
        .agg(
            F.sort_array(F.collect_list(F.when(~span, interval))).alias("intervals"),
            F.min(F.when(~span & F.col("crossed"), F.col("date_t2"))).alias("first_crossing"),
            F.max(F.when(span, F.struct("step", *span_fields))).alias("span"),
        )
        .select(
            *CELL,
            "intervals",
            "first_crossing",
            F.col("span.step").alias("n_dates"),
            *[F.col(f"span.{c}").alias(c) for c in span_fields],
        )
        .withColumn("earliest_change", earliest_change(rules))
    )


def earliest_change(rules: ChangeRules = ChangeRules()) -> Column:
    """First crossing interval's end; else, with more than two dates, the whole span if it crosses."""
    whole = (F.col("n_dates") > 2) & ~F.col("suppressed") & (F.col("confidence") >= rules.confidence_threshold)
    return F.coalesce(F.col("first_crossing"), F.when(whole, F.col("date_t2")))


def detect_scene_change(
    tiles: DataFrame,
    dates: Sequence[str],
    sensor: str | None = None,
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    limit: bool = True,
    model: PipelineModel | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Change candidates of a whole scene sequence, largest drift first."""
    history = cell_history(tiles, dates, sensor, rules, max_ratio, need_ends=True, model=model, matched=matched)
    found = history.filter(~F.col("suppressed") & (F.col("drift") >= rules.drift_threshold))
    return change_top_k(found, rules.top_k) if limit else found


def change_top_k(candidates: DataFrame, top_k: int = config.CHANGE_TOP_K) -> DataFrame:
    return candidates.orderBy(F.col("drift").desc(), "t1_tile_id").limit(top_k)


def describe_candidates(candidates: DataFrame, sensor: str, classifier: str = config.FALLBACK_LABEL) -> DataFrame:
    """Candidates with classifier inputs, whole-percent cloud cover and before / after texts."""
    return candidates.select(
        "*",
        F.lit(sensor).alias("sensor"),
        F.rint(F.col("cloud_t2") * 100).cast("int").alias("cloud_cover"),
        before_text(sensor).alias("before_desc"),
        after_text().alias("after_desc"),
        confidence_factors(candidates, classifier).alias("confidence_factors"),
    )


def before_text(sensor: str) -> Column:
    return F.concat(F.lit("Baseline observation from "), "date_t1", F.lit(f" ({sensor})"))


def after_text() -> Column:
    return F.concat(F.lit("Spectral drift: "), F.format_number("drift", 3), F.lit(" observed on "), F.col("date_t2"))


def detect_tile_change(
    tiles: DataFrame,
    reviews: DataFrame,
    tile_id: str,
    dates: Sequence[str],
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
    model: PipelineModel | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """The history of one tile's cell; stored review values win over computed ones."""
    ends = tiles.sparkSession.range(1).select(
        identity.split_change_id(F.lit(tile_id), dates[0], dates[-1]).alias("ends")
    )
    wanted = ends.select(F.explode(F.array("ends.t1", "ends.t2")).alias("tile_id"))
    cell = tiles.join(wanted, "tile_id", "left_semi").select(*CELL).distinct()
    computed = cell_history(tiles.join(cell, CELL, "left_semi"), dates, None, rules, max_ratio, model=model, matched=matched)
    return review_candidate_join(computed, reviews)


def review_candidate_join(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored review values over recomputed ones, matched by composite id, then by either tile id."""
    ids = F.array(
        F.concat(F.col("t1_tile_id"), F.lit("__"), F.col("t2_tile_id")), F.col("t2_tile_id"), F.col("t1_tile_id")
    )
    keyed = candidates.select(F.struct(*candidates.columns).alias("c"), F.posexplode(ids).alias("id_rank", "tile_id"))
    stored = top_per_key(reviews, ["tile_id"], [F.col("id")]).select(
        "tile_id",
        F.col("id").alias("review_id"),
        F.coalesce(F.col("drift_score"), F.lit(0.0)).alias("stored_drift"),
        F.col("confidence").alias("stored_confidence"),
    )
    hit = keyed.join(stored, "tile_id", "left")
    best = top_per_key(
        hit, ["c.t1_tile_id", "c.t2_tile_id"], [F.col("review_id").isNull(), F.col("id_rank")]
    )
    reviewed = F.col("review_id").isNotNull()
    out = best.select("c.*", "review_id", "stored_drift", "stored_confidence")
    return (
        out.withColumn("drift", F.when(reviewed, F.col("stored_drift")).otherwise(F.col("drift")))
        .withColumn("similarity", F.when(reviewed, F.lit(1.0) - F.col("stored_drift")).otherwise(F.col("similarity")))
        .withColumn("confidence", F.when(reviewed, F.col("stored_confidence")).otherwise(F.col("confidence")))
        .withColumn("suppressed", ~reviewed & F.col("suppressed"))
        .withColumn("reason", F.when(~reviewed, F.col("reason")))
        .drop("stored_drift", "stored_confidence")
    )


def review_rows(candidates: DataFrame) -> DataFrame:
    """Pending review rows for all candidates (not only the top k)."""
    return candidates.select(
        F.concat("t1_tile_id", F.lit("__"), "t2_tile_id").alias("tile_id"),
        "t1_tile_id",
        "t2_tile_id",
        F.lit("PENDING").alias("status"),
        "confidence",
        F.col("drift").alias("drift_score"),
        F.concat(
            F.lit("Multi-temporal detection. Earliest change: "), F.coalesce("earliest_change", F.lit("None"))
        ).alias("remarks"),
        "date_t1",
        "date_t2",
        *(["bbox_json"] if "bbox_json" in candidates.columns else []),
    )


def with_boxes(candidates: DataFrame, tiles: DataFrame) -> DataFrame:
    """Candidates with bbox_json, the second tile's bounds and projection; null where it has none."""
    box = F.struct(F.lit("Polygon").alias("type"), "crs", "bounds")
    boxes = tiles.groupBy(F.col("tile_id").alias("t2_tile_id")).agg(F.min(F.when(F.col("bounds").isNotNull(), F.to_json(box))).alias("bbox_json"))
    return candidates.join(boxes, "t2_tile_id", "left")


def audit_rows(candidates: DataFrame, sensor: str) -> DataFrame:
    """Ledger rows for the reported (top k) candidates; a tile's id is its image path."""
    return candidates.select(
        F.concat("t1_tile_id", F.lit("__"), "t2_tile_id").alias("id"),
        F.lit("detected-change").alias("primary_tag"),
        F.lit(0).alias("cluster"),
        F.col("confidence").alias("anomaly_score"),
        F.lit("pending").alias("status"),
        before_text(sensor).alias("before_desc"),
        after_text().alias("after_desc"),
        F.col("t1_tile_id").alias("before_image_path"),
        F.col("t2_tile_id").alias("after_image_path"),
        F.lit(sensor).alias("sensor"),
        F.col("date_t2").alias("date"),
    )


def ledger_consistency(recomputed: DataFrame, stored: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Whether stored drift and confidence equal the recomputed ones."""
    both = recomputed.select("tile_id", "drift", "confidence").join(
        stored.select("tile_id", "drift_score", F.col("confidence").alias("stored_confidence")), "tile_id"
    )
    same = (F.abs(F.col("drift") - F.col("drift_score")) < tolerance) & (
        F.abs(F.col("confidence") - F.col("stored_confidence")) < tolerance
    )
    return both.withColumn("consistent", F.coalesce(same, F.lit(False)))
