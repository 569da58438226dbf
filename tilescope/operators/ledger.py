"""The tile point store and the audit ledger: upserts, audits and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.ranking import top_per_key

AUDIT_VALUES = [
    "image_path", "primary_tag", "cluster", "anomaly_score", "status",
    "before_desc", "after_desc", "before_image_path", "after_image_path",
]
AUDIT_KEPT = ["sensor", "date"]  # a null in the feed keeps the stored value


def vector_upsert(stored: DataFrame, feed: DataFrame, version: str = "version") -> DataFrame:
    """Insert or replace points by id; the highest version wins."""
    both = stored.unionByName(feed, allowMissingColumns=True)
    return top_per_key(both, ["point_id"], [F.col(version).desc()])


def schema_evolve(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """Add the missing nullable columns."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in added.items()))
    return df.unionByName(wanted, allowMissingColumns=True)


def reduce_feed(feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per id from an upsert feed: last value, or last known value for the kept columns."""
    at = F.struct(*order)
    values = [c for c in AUDIT_VALUES if c in feed.columns]
    kept = [c for c in AUDIT_KEPT if c in feed.columns]
    latest = F.max(F.struct(at.alias("at"), *values))
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), c))).alias(c) for c in kept]
    reduced = feed.groupBy("id").agg(latest.alias("last"), *known, F.min(F.col(order[0])).alias("created_at"))
    return reduced.select(
        "id", *[F.col(f"last.{c}").alias(c) for c in values], *[F.col(f"{c}.{c}").alias(c) for c in kept], "created_at"
    )


def audit_upsert(stored: DataFrame, feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Merge an upsert feed into the ledger.

    New rows are inserted; existing ones take all feed values, except that
    sensor and date keep the stored value when the feed has none, and created_at
    never changes. Columns that only the feed has are added.
    """
    new = reduce_feed(feed, order)
    old = stored.alias("old")
    joined = old.join(new.alias("new"), F.col("old.id") == F.col("new.id"), "full_outer")
    fresh = F.col("new.id").isNotNull()
    columns: list[Column] = [F.coalesce("new.id", "old.id").alias("id")]
    for c in stored.columns:
        if c in ("id", "created_at"):
            continue
        if c in AUDIT_KEPT and c in new.columns:
            columns.append(F.coalesce(f"new.{c}", f"old.{c}").alias(c))
        elif c in new.columns:
            columns.append(F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            columns.append(F.col(f"old.{c}").alias(c))
    columns += [F.col(f"new.{c}").alias(c) for c in new.columns if c not in stored.columns and c != "created_at"]
    columns.append(F.coalesce("old.created_at", "new.created_at").alias("created_at"))
    return joined.select(*columns)


def status_update(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set status where a decision (id, new_status) exists."""
    return (
        ledger.join(decisions.select("id", "new_status"), "id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )


def anomalous_tiles(ledger: DataFrame, limit: int | None = 50) -> DataFrame:
    """Tagged or positively scored rows, highest score first."""
    rows = ledger.filter((F.col("primary_tag") != "unassigned") | (F.col("anomaly_score") > 0))
    if limit is None:
        return rows
    return rows.orderBy(F.col("anomaly_score").desc(), F.col("created_at").desc(), "id").limit(limit)


def ingest_status(ledger: DataFrame) -> DataFrame:
    """One row: tile and anomaly counts, date span and sensors of the ledger."""
    unassigned = F.col("primary_tag") == "unassigned"
    anomalous = (F.col("primary_tag") != "unassigned") | (F.col("anomaly_score") > 0)
    date = F.nullif(F.col("date"), F.lit(""))
    sensor = F.nullif(F.col("sensor"), F.lit(""))
    counts = ledger.agg(
        F.count_if(unassigned).alias("n_unassigned"),
        F.count_if(anomalous).alias("anomalies_detected"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.sort_array(F.collect_set(sensor)).alias("sensors"),
    )
    total = F.col("n_unassigned") + F.col("anomalies_detected")
    span = (
        F.when(F.col("first_date").isNull(), F.lit("No data ingested yet"))
        .when(F.col("first_date") == F.col("last_date"), F.col("first_date"))
        .otherwise(F.concat("first_date", F.lit(" to "), "last_date"))
    )
    return counts.select(
        F.when(F.col("n_unassigned") == 0, total).otherwise(F.col("n_unassigned")).alias("tile_count"),
        "anomalies_detected",
        total.alias("total_records"),
        span.alias("date_range"),
        F.when(F.size("sensors") == 0, F.array(F.lit("Sentinel-2"))).otherwise(F.col("sensors")).alias("sensors"),
    )


def classify_points(points: DataFrame, prefix: str) -> DataFrame:
    """Label every stored point valid, stale (foreign prefix) or repeated.

    The kept point of a tile is the smallest id; it is found by a minimum that
    combines before the shuffle and comes back by an equi join, so a tile id
    with very many copies is never gathered in one place.
    """
    foreign = ~F.coalesce(F.col("tile_id"), F.lit("")).startswith(prefix)
    keepers = points.filter(~foreign).groupBy("tile_id").agg(F.min("point_id").alias("point_id"))
    kept = keepers.select("point_id", F.lit(True).alias("__keep"))
    marked = points.join(kept, "point_id", "left")
    state = (
        F.when(foreign, F.lit("stale"))
        .when(F.col("__keep").isNull(), F.lit("repeated"))
        .otherwise(F.lit("valid"))
    )
    return marked.withColumn("state", state).drop("__keep")


def stale_points(points: DataFrame, prefix: str) -> DataFrame:
    return classify_points(points, prefix).filter(F.col("state") != "valid")


def clean_points(points: DataFrame, prefix: str) -> DataFrame:
    """Exactly one point per tile id of the area."""
    return classify_points(points, prefix).filter(F.col("state") == "valid").drop("state")


def point_audit(points: DataFrame, prefix: str) -> DataFrame:
    """Totals of the store by state, from two pre-aggregated counts."""
    foreign = ~F.coalesce(F.col("tile_id"), F.lit("")).startswith(prefix)
    per_tile = points.groupBy("tile_id", foreign.alias("foreign")).agg(F.count(F.lit(1)).alias("n"))
    return per_tile.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"),
        F.count_if(~F.col("foreign")).alias("valid_tiles"),
        F.coalesce(F.sum(F.when(F.col("foreign"), F.col("n"))), F.lit(0)).alias("stale_points"),
        F.coalesce(F.sum(F.when(~F.col("foreign"), F.col("n") - 1)), F.lit(0)).alias("repeated_points"),
    )
