"""Provenance documents of reviewed hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions import identity
from tilescope.functions.ranking import top_per_key
from tilescope.operators.review import bbox_from_json

SCHEMA_NAME = "HotspotProvenance.v1"
FEATURE_ORDER = ["drift", "similarity", "cloud_ratio_t1", "cloud_ratio_t2", "days_between", "month_t1", "month_t2"]


def audit_items(ledger: DataFrame, queue: DataFrame) -> DataFrame:
    """Ledger rows without a queue item, shaped like queue items, so they can be exported too."""
    alone = ledger.join(queue.select(F.col("tile_id").alias("id")), "id", "left_anti")
    none = F.lit(None).cast("string")
    score = F.coalesce("anomaly_score", F.lit(0.0))
    return alone.select(
        F.lit(None).cast("long").alias("id"),
        F.col("id").alias("tile_id"),
        none.alias("t1_tile_id"),
        none.alias("t2_tile_id"),
        "status",
        score.alias("confidence"),
        score.alias("drift_score"),
        none.alias("remarks"),
        none.alias("bbox_json"),
        F.col("date").alias("date_t1"),
        none.alias("date_t2"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def _half(part: int) -> Column:
    """A side's tile id: the stored one, else that half of the composite id, else a made-up one."""
    stored = F.col(f"t{part}_tile_id")
    halves = identity.id_halves(F.col("tile_id"))
    return F.coalesce(
        identity.first_truthy(stored),
        F.when(F.col("tile_id").contains("__"), halves[part - 1]),
        F.concat("tile_id", F.lit(f"_t{part}")),
    )


def provenance_doc(
    queue: DataFrame,
    ledger: DataFrame,
    quality: DataFrame,
    spectral: DataFrame,
    date_first: str,
    date_last: str,
    exported_at: Column,
    exporter: str = "tilescope",
    model: str | None = None,
    dimension: int | None = None,
    histogram_matched: bool | None = None,
    earliest: DataFrame | None = None,
) -> DataFrame:
    """One six-section document per queue item.

    `quality` is (tile_id, cloud), `spectral` is keyed by tile_id with index means
    and changes. Cloud ratios and dates are measured values from those tables;
    where nothing was measured the field is null. Several rows of a tile are
    reduced to one (mean cloud, the first of each index), so that an item stays
    one document. `model`, `dimension` and `histogram_matched` say how the
    vectors were made and are null if the caller does not know; `earliest` is
    (tile_id, earliest_change).
    """
    quality = quality.groupBy("tile_id").agg(F.avg("cloud").alias("cloud"))
    measured = [c for c in spectral.columns if c != "tile_id"]
    spectral = spectral.groupBy("tile_id").agg(*[F.min(c).alias(c) for c in measured])
    if earliest is None:
        earliest = queue.select("tile_id", F.lit(None).cast("string").alias("earliest_change")).limit(0)
    earliest = earliest.groupBy("tile_id").agg(F.min("earliest_change").alias("earliest_change"))
    audit = ledger.select(
        F.col("id").alias("tile_id"),
        F.lit(True).alias("in_ledger"),
        F.col("sensor").alias("audit_sensor"),
        "before_image_path",
        "after_image_path",
    )
    items = (
        queue.withColumn("t1", _half(1))
        .withColumn("t2", _half(2))
        .withColumn("d1", F.coalesce(identity.first_truthy("date_t1"), F.lit(date_first)))
        .withColumn("d2", F.coalesce(identity.first_truthy("date_t2"), F.lit(date_last)))
    )
    q1 = quality.select(F.col("tile_id").alias("t1"), F.col("cloud").alias("c1"))
    q2 = quality.select(F.col("tile_id").alias("t2"), F.col("cloud").alias("c2"))
    rows = (
        items.join(audit, "tile_id", "left")
        .join(q1, "t1", "left")
        .join(q2, "t2", "left")
        .join(spectral.withColumnRenamed("tile_id", "t2").withColumn("spectral_computed", F.lit(True)), "t2", "left")
        .join(earliest, "tile_id", "left")
    )
    days, month_1, month_2 = identity.date_features(F.col("d1"), F.col("d2"))
    drift = F.round(F.coalesce("drift_score", F.lit(0.0)), 4)
    similarity = F.round(F.greatest(F.lit(0.0), F.lit(1.0) - drift), 4)
    status = F.upper(F.col("status"))
    features = F.struct(
        drift.alias("drift"),
        similarity.alias("similarity"),
        F.col("c1").alias("cloud_ratio_t1"),
        F.col("c2").alias("cloud_ratio_t2"),
        days.alias("days_between"),
        month_1.alias("month_t1"),
        month_2.alias("month_t2"),
    )

    def index(name: str) -> Column:
        return F.struct(*[F.round(f"{name}_{x}", 4).alias(y) for x, y in (("t1", "t1_mean"), ("t2", "t2_mean"), ("change", "change"))])

    document = F.struct(
        F.struct(
            F.lit(SCHEMA_NAME).alias("schema"),
            F.lit("1.0").alias("export_version"),
            exported_at.alias("export_timestamp"),
            F.lit(exporter).alias("exported_by"),
            F.col("id").alias("item_id"),
            F.col("tile_id").alias("hotspot_id"),
        ).alias("provenance_metadata"),
        F.struct(
            F.col("t1").alias("t1_tile_id"),
            F.col("t2").alias("t2_tile_id"),
            F.col("tile_id").alias("composite_tile_id"),
            F.when(F.col("in_ledger"), F.col("audit_sensor")).otherwise(F.lit("Sentinel-2 (MSI L2A)")).alias("sensor"),
            F.struct(
                F.col("d1").alias("date_t1"),
                F.col("d2").alias("date_t2"),
                days.alias("temporal_interval_days"),
                F.col("earliest_change").alias("earliest_change_date"),
            ).alias("acquisition_dates"),
            F.struct("before_image_path", "after_image_path").alias("file_paths"),
            bbox_from_json(F.col("bbox_json")).alias("bounding_box"),
        ).alias("source_scenes"),
        F.struct(
            F.struct(
                F.lit(True).alias("applied"),
                F.col("c1").alias("cloud_shadow_masking_ratio_t1"),
                F.col("c2").alias("cloud_shadow_masking_ratio_t2"),
                F.lit(config.CLOUD_BRIGHTNESS).alias("cloud_brightness_threshold"),
                F.lit(config.SHADOW_BRIGHTNESS).alias("shadow_brightness_threshold"),
                F.lit(config.CLOUD_SHADOW_MAX_RATIO).alias("max_ratio_allowed"),
            ).alias("cloud_shadow_masking"),
            F.lit(None if histogram_matched is None else "yes" if histogram_matched else "no")
            .cast("string")
            .alias("histogram_matching_applied"),
            F.lit(model).cast("string").alias("openclip_model_version"),
            F.lit(dimension).cast("int").alias("embedding_dimension"),
        ).alias("processing_steps"),
        F.struct(
            drift.alias("drift_score"),
            similarity.alias("similarity_score"),
            F.round("confidence", 4).alias("rf_confidence_score"),
            F.array(*[F.lit(name) for name in FEATURE_ORDER]).alias("feature_order"),
            features.alias("exact_7_features"),
        ).alias("metrics_and_classification"),
        F.struct(
            status.alias("decision"),
            identity.decision_display(status).alias("decision_display"),
            F.col("updated_at").alias("timestamp"),
            F.col("created_at").alias("created_at"),
            F.coalesce(
                identity.first_truthy("remarks"), F.concat(F.lit("Triage status: "), identity.decision_display(status))
            ).alias("remarks"),
            status.isin("CONFIRMED", "ACCEPT", "REJECTED", "REJECT").alias("verified_by_analyst"),
        ).alias("analyst_review"),
        F.struct(
            F.coalesce("spectral_computed", F.lit(False)).alias("computed"),
            index("ndvi").alias("ndvi"),
            index("ndbi").alias("ndbi"),
            index("ndwi").alias("ndwi"),
        ).alias("spectral_indices"),
    )
    return rows.select("id", "tile_id", document.alias("doc"))


def export_name(tile_id: Column, item_id: Column) -> Column:
    prefix = identity.safe_name(tile_id, 32)
    number = F.coalesce(item_id.cast("string"), F.lit("rec"))
    return F.concat(F.lit("provenance_hotspot_"), number, F.lit("_"), prefix, F.lit(".json"))


def provenance_export(documents: DataFrame) -> DataFrame:
    """File name and JSON text of every document."""
    return documents.select(
        "id",
        export_name(F.col("tile_id"), F.col("id")).alias("file_name"),
        F.to_json("doc", {"ignoreNullFields": "false"}).alias("json"),
    )


def find_records(queue: DataFrame, ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Queue item of each requested id: by number, else by tile id. (Fuzzy search is per id, see review.)"""
    by_number = requests.join(
        queue.withColumn("__key", F.col("id").cast("string")), F.col("request_id") == F.col("__key")
    ).withColumn("__grade", F.lit(0))
    by_tile = requests.join(
        queue.withColumn("__key", F.col("tile_id")), F.col("request_id") == F.col("__key")
    ).withColumn("__grade", F.lit(1))
    both = by_number.unionByName(by_tile).drop("__key")
    return top_per_key(both, ["request_id"], [F.col("__grade"), F.col("id")]).drop("__grade")
