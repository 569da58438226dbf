"""Hotspots: the map view over ledger and tile attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope import config
from tilescope.config import SceneExtent
from tilescope.functions import geodesy, identity
from tilescope.functions.identity import first_truthy
from tilescope.functions.ranking import top_per_key
from tilescope.operators.ledger import anomalous_tiles, status_update
from tilescope.session import checkpointed


def hotspot_payload_join(ledger: DataFrame, payload: DataFrame) -> DataFrame:
    """Ledger rows with the payload of the first half of their id that exists."""
    halves = ledger.select("id", F.posexplode(identity.id_halves(F.col("id"))).alias("part", "tile_id"))
    # Only payloads that some ledger row asks for are ranked.
    asked = payload.join(halves.select("tile_id").distinct(), "tile_id", "left_semi")
    stored = top_per_key(asked, ["tile_id"], [F.col("point_id")])
    found = top_per_key(halves.join(stored, "tile_id"), ["id"], [F.col("part")])
    renamed = found.select("id", "part", *[F.col(c).alias(f"p_{c}") for c in payload.columns])
    return ledger.join(renamed, "id", "left")


def cloud_cover_pick(stored: list[Column], computed_ratio: Column, default: int = 5) -> Column:
    """First stored percentage that is set and not zero, else the computed one, else the default."""
    return F.coalesce(
        identity.first_nonzero(*stored).cast("int"), F.rint(computed_ratio * 100).cast("int"), F.lit(default)
    )


def hotspot_list(
    ledger: DataFrame, payload: DataFrame, extent: SceneExtent, limit: int | None = 100
) -> DataFrame:
    """Anomalous ledger rows with position, confidence, cloud cover and descriptions."""
    rows = anomalous_tiles(ledger, limit)
    joined = hotspot_payload_join(rows, payload)
    placed = geodesy.add_center_wgs84(joined, "p_bounds", "p_crs", "__lat", "__lng")
    # Rows without geometry come out at (0, 0) and are placed by their grid position.
    grid = geodesy.grid_geolocate(F.col("id"), extent)
    unplaced = (F.col("__lat") == 0.0) & (F.col("__lng") == 0.0)
    return placed.select(
        "id",
        F.when(unplaced, grid["lat"]).otherwise(F.col("__lat")).alias("lat"),
        F.when(unplaced, grid["lng"]).otherwise(F.col("__lng")).alias("lng"),
        F.coalesce(first_truthy("primary_tag"), F.lit("unassigned")).alias("classification"),
        identity.clamp_confidence(F.col("anomaly_score")).alias("confidence"),
        F.coalesce(first_truthy("sensor", "p_sensor"), F.lit("Sentinel-2")).alias("sensor"),
        F.coalesce(first_truthy("date", "p_date"), F.col("created_at").cast("string"), F.lit("")).alias("date"),
        cloud_cover_pick([F.col("cloud_cover"), F.col("p_cloud_cover")], F.col("p_cloud")).alias("cloud_cover"),
        F.coalesce(first_truthy("status"), F.lit("pending")).alias("status"),
        first_truthy("before_desc").alias("before_desc"),
        first_truthy("after_desc").alias("after_desc"),
        "image_path",
        first_truthy("before_image_path").alias("before_image_path"),
        first_truthy("after_image_path").alias("after_image_path"),
        F.col("p_bounds").alias("bounds"),
        "created_at",
    )


def with_factors(spots: DataFrame, scored: DataFrame) -> DataFrame:
    """Add drift and similarity: the stored drift of the same id, else a quarter of the confidence."""
    stored = scored.groupBy("tile_id").agg(F.min(F.struct("id", "drift_score")).alias("__s"))
    drift = F.coalesce(F.col("__s.drift_score"), F.col("confidence") * config.DRIFT_THRESHOLD)
    joined = spots.join(stored.withColumnRenamed("tile_id", "id"), "id", "left")
    return joined.withColumn("drift", drift).withColumn("similarity", F.lit(1.0) - F.col("drift")).drop("__s")


def hotspot_decide(ledger: DataFrame, queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply analyst decisions (id, new_status) to the ledger and mirror them in the queue.

    The queue row of a tile is its smallest id; it takes the normalised status
    and a remark.
    """
    return status_update(ledger, decisions), mirror_decisions(queue, mirrored_rows(ledger, queue, decisions))


def mirrored_rows(ledger: DataFrame, queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, new_status) of the queue rows that take the decisions on tiles the ledger knows."""
    known = decisions.join(ledger, "id", "left_semi").select(F.col("id").alias("tile_id"), "new_status")
    target = queue.join(known, "tile_id", "left_semi").groupBy("tile_id").agg(F.min("id").alias("id"))
    return target.join(known, "tile_id").select("id", "new_status")


def mirror_decisions(queue: DataFrame, mirror: DataFrame) -> DataFrame:
    """The queue with the decisions of mirrored_rows."""
    hit = F.col("new_status").isNotNull()
    return (
        queue.join(mirror, "id", "left")
        .withColumn("status", F.when(hit, identity.normalise_status(F.col("new_status"))).otherwise(F.col("status")))
        .withColumn(
            "remarks",
            F.when(hit, F.concat(F.lit("Analyst triage decision: "), "new_status")).otherwise(F.col("remarks")),
        )
        .drop("new_status")
    )


SMALL = 100_000  # rows of squares or places that every task may hold
MOST_LEVELS = 12  # squares of reach / 8**12, far below the precision of a position


def nearest_hotspot(
    clicks: DataFrame, hotspots: DataFrame, reach: float = 0.5, order: str = "id", fan: int = 8, leaf_size: int = 32
) -> DataFrame:
    """The nearest hotspot within `reach` degrees of each click; the last in order wins ties.

    Squares of side `reach` are refined into fan x fan squares until the most
    crowded one holds at most `leaf_size` places, so a click meets no more of
    them however many hotspots there are; two places closer than the side of
    the MOST_LEVELS-th square count as one square's. At each level a click keeps
    only the occupied squares that can still hold its nearest hotspot (nearest
    edge no farther than the best farthest corner), so a square that holds a
    third of all hotspots is narrowed down before any click meets a hotspot, and
    pairs are never formed wholesale.
    """

    def square(value: Column, level: int) -> Column:
        return F.floor(value * (fan**level / reach)).cast("long")

    # Hotspots at one location can only tie, so the last of them stands for all.
    # The table is read several times per level, so it is written once and read back.
    places = checkpointed(top_per_key(hotspots, ["lat", "lng"], [F.col(order).desc()]))
    levels = 0
    while levels < MOST_LEVELS:
        held = places.groupBy(square(F.col("lat"), levels).alias("y"), square(F.col("lng"), levels).alias("x")).count()
        if (held.agg(F.max("count")).first()[0] or 0) <= leaf_size:
            break
        levels += 1
    for level in range(levels + 1):
        places = places.withColumn(f"__y{level}", square(F.col("lat"), level)).withColumn(
            f"__x{level}", square(F.col("lng"), level)
        )

    # The optimizer does not know how many squares a click is given and would broadcast the clicks with all of them.
    # No level has more squares than there are places, so these are broadcast where they are few, else merged.
    how = "broadcast" if places.count() <= SMALL else "merge"
    tasks = 3 * clicks.sparkSession.sparkContext.defaultParallelism
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    front = (
        clicks.repartition(tasks, "click_id").select("click_id", F.col("lat").alias("click_lat"), F.col("lng").alias("click_lng"))
        .withColumn("__dy", F.explode(near))
        .withColumn("__dx", F.explode(near))
        .withColumn("__y0", square(F.col("click_lat"), 0) + F.col("__dy"))
        .withColumn("__x0", square(F.col("click_lng"), 0) + F.col("__dx"))
        .drop("__dy", "__dx")
    )
    for level in range(levels + 1):
        here = [f"__y{level}", f"__x{level}"]
        parent = [f"__y{level - 1}", f"__x{level - 1}"] if level else here
        occupied = places.select(*dict.fromkeys([*parent, *here])).distinct()
        side = reach / fan**level
        front = front.join(occupied.hint(how), parent)

        def gap(at: str, cell: str) -> tuple[Column, Column]:
            low, high = F.col(cell) * side - F.col(at), (F.col(cell) + 1) * side - F.col(at)
            return F.greatest(low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))

        (near_y, far_y), (near_x, far_x) = gap("click_lat", here[0]), gap("click_lng", here[1])
        slack = 1e-9  # square borders are computed, so keep borderline squares
        front = (
            front.withColumn("__near", F.hypot(near_y, near_x) - slack)
            .withColumn("__far", F.hypot(far_y, far_x) + slack)
            .withColumn("__best", F.min("__far").over(Window.partitionBy("click_id")))
            .filter((F.col("__near") <= F.col("__best")) & (F.col("__near") <= reach))
            .select("click_id", "click_lat", "click_lng", *here)
        )
    leaf = [f"__y{levels}", f"__x{levels}"]
    keep = [c for c in hotspots.columns]
    distance = F.sqrt(F.pow(F.col("lat") - F.col("click_lat"), 2) + F.pow(F.col("lng") - F.col("click_lng"), 2))
    found = (
        front.join(places.select(*keep, *leaf).hint(how), leaf)
        .drop(*leaf)
        .withColumn("distance", distance)
        .filter(F.col("distance") <= reach)
    )
    return top_per_key(found, ["click_id"], [F.col("distance"), F.col(order).desc()])
