"""The analysts' review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.ranking import top_per_key, with_global_rank
from tilescope.session import checkpointed

STATUSES = ("PENDING", "CONFIRMED", "REJECTED", "FLAGGED")  # fixed values: queue states
BBOX_SCHEMA = "type string, crs string, bounds array<double>"


def review_append(queue: DataFrame, rows: DataFrame, order: list[str], now: Column) -> DataFrame:
    """Append rows with ids that continue the queue's numbering.

    `order` must identify a row. Repeated runs append again, as the queue has no
    uniqueness rule.
    """
    return queue.unionByName(numbered_rows(queue, rows, order, now), allowMissingColumns=True)


def numbered_rows(queue: DataFrame, rows: DataFrame, order: list[str], now: Column) -> DataFrame:
    """The rows that review_append adds."""
    start = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start")).scalar()
    # Numbering reads the rows more than once and must see the same rows each time.
    numbered = with_global_rank(checkpointed(rows), order, "__rank")
    return (
        numbered.withColumn("id", start + F.col("__rank"))
        .withColumn("created_at", now)
        .withColumn("updated_at", now)
        .drop("__rank")
    )


def review_update(queue: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Partial updates (id, new_status, new_confidence, new_remarks); nulls leave values alone.

    An update that sets nothing, or an unknown status or confidence, is an error.
    """
    empty = F.col("new_status").isNull() & F.col("new_confidence").isNull() & F.col("new_remarks").isNull()
    bad = ~F.coalesce(F.col("new_status"), F.lit("PENDING")).isin(*STATUSES) | ~F.coalesce(
        F.col("new_confidence"), F.lit(0.0)
    ).between(0.0, 1.0)
    checked = updates.select(
        F.when(empty | bad, F.raise_error(F.lit("invalid review update")).cast("long"))
        .otherwise(F.col("id"))
        .alias("id"),
        "new_status",
        "new_confidence",
        "new_remarks",
        F.lit(True).alias("__hit"),
    )
    joined = queue.join(checked, "id", "left")
    return (
        joined.withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("confidence", F.coalesce("new_confidence", "confidence"))
        .withColumn("remarks", F.coalesce("new_remarks", "remarks"))
        .withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at")))
        .drop("new_status", "new_confidence", "new_remarks", "__hit")
    )


def review_page(queue: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the queue, newest first."""
    rows = queue.filter(F.col("status") == status) if status else queue
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def review_after(queue: DataFrame, created_at: object, item_id: int, status: str | None = None, limit: int = 100) -> DataFrame:
    """The page that follows a given last row (its created_at and id): no offset to read past, however deep."""
    rows = queue.filter(F.col("status") == status) if status else queue
    later = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("id") < item_id))
    return rows.filter(later).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def review_get(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The first queue row (smallest id) of each requested tile_id."""
    return top_per_key(queue.join(requests, "tile_id", "left_semi"), ["tile_id"], [F.col("id")])


def bbox_from_json(text: Column) -> Column:
    """Parsed bounding box; null where the text is missing or broken."""
    return F.from_json(text, BBOX_SCHEMA)


def record_fuzzy_match(queue: DataFrame, wanted: str) -> DataFrame:
    """Queue rows an id may mean, best first: its number, its tile id, then either text containing the other."""
    exact_id = F.col("id").cast("string") == wanted
    exact_tile = F.col("tile_id") == wanted
    partial = F.col("tile_id").contains(wanted) | F.lit(wanted).contains(F.col("tile_id"))
    grade = F.when(exact_id, 0).when(exact_tile, 1).when(partial, 2)
    return (
        queue.withColumn("match_grade", grade)
        .filter(F.col("match_grade").isNotNull())
        .orderBy("match_grade", F.col("created_at").desc(), F.col("id").desc())
    )


def audit_fuzzy_match(ledger: DataFrame, wanted: str) -> DataFrame:
    """The newest ledger row whose id contains the text, for ids the queue does not know."""
    hit = ledger.filter(F.col("id").contains(wanted))
    return hit.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(1)
