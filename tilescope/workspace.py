"""A project's stores and everything that can be asked of them.

Ties the operators to a folder of tables: tile points, and a keyed store with the
audit ledger and the review queue.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope import config
from tilescope.config import ChangeRules, SceneExtent
from tilescope.functions import geodesy
from tilescope.operators import change, discovery, embedding, hotspots, learning, ledger, provenance, review, search, tiling
from tilescope.session import checkpointed, ship_package
from tilescope.sources.bucket_store import BucketStore, Transaction
from tilescope.sources.document_sink import write_documents
from tilescope.sources.stores import VersionedTable

# Columns of the two ledgers.
LEDGER_SCHEMA = (
    "id string, image_path string, primary_tag string, cluster int, anomaly_score double, status string, "
    "before_desc string, after_desc string, before_image_path string, after_image_path string, "
    "sensor string, date string, cloud_cover double, created_at timestamp"
)
QUEUE_SCHEMA = (
    "id long, tile_id string, t1_tile_id string, t2_tile_id string, status string, confidence double, "
    "drift_score double, remarks string, bbox_json string, date_t1 string, date_t2 string, "
    "created_at timestamp, updated_at timestamp"
)


class Workspace:
    """Ingest, search, change detection, review and discovery over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, extent: SceneExtent, now: Callable[[], Column] = F.current_timestamp):
        self.spark, self.extent, self.now = ship_package(spark), extent, now
        # Searches and change detection name dates, so dates are folders and the rest is not read.
        self.points_store = VersionedTable(spark, f"{folder}/points", ["date"])
        # Keyed updates go to the buckets of their ids, and both tables change in one commit.
        self.records = BucketStore(spark, f"{folder}/records", {"ledger": "id", "queue": "id"})

    # -- stores ----------------------------------------------------------------

    def points(self) -> DataFrame:
        found = self.points_store.read()
        if found is None:
            raise LookupError("nothing has been ingested")
        return found

    def ledger(self) -> DataFrame:
        found = self.records.read("ledger")
        return self.spark.createDataFrame([], LEDGER_SCHEMA) if found is None else found

    def queue(self) -> DataFrame:
        found = self.records.read("queue")
        return self.spark.createDataFrame([], QUEUE_SCHEMA) if found is None else found

    def _keeping_status(self, rows: DataFrame, otherwise: str = "pending") -> DataFrame:
        """Rows with the status that an analyst gave their id before, if any."""
        status = self.ledger().select("id", F.col("status").alias("kept"))
        kept = rows.drop("status").join(status, "id", "left")
        return kept.withColumn("status", F.coalesce("kept", F.lit(otherwise))).drop("kept")

    def _upsert_ledger(self, change: Transaction, rows: DataFrame) -> None:
        empty = self.spark.createDataFrame([], LEDGER_SCHEMA)
        feed = empty.drop("created_at").unionByName(rows, allowMissingColumns=True).withColumn("at", self.now())
        change.merge("ledger", feed, lambda old, new: ledger.audit_upsert(empty if old is None else old, new, ["at"]))

    # -- ingest ----------------------------------------------------------------

    def ingest(
        self,
        pixels: DataFrame,
        scenes: DataFrame,
        bands: Sequence[str],
        model: embedding.ModelFactory,
        size: int = config.TILE_SIZE,
        overlap: int = 0,
    ) -> int:
        """Cut, screen, embed and store the tiles of some scenes; returns the new store version."""
        tiles = tiling.ingest_tiles(pixels, scenes, bands, size, overlap)
        placed = tiling.place_in_windows(pixels, size, tiling.stride_of(size, overlap))
        kept = placed.join(tiles.select(*tiling.TILE_KEYS), tiling.TILE_KEYS, "left_semi")
        vectors = embedding.embed_tiles(embedding.tile_chips(kept, tiling.TILE_KEYS, bands[:3]), model)
        sites = scenes.select("scene_id", "site")
        stored = self.points_store.read()
        version = 1 if stored is None else stored.agg(F.max("version")).first()[0] + 1
        points = (
            tiles.join(vectors, tiling.TILE_KEYS)
            .join(sites, "scene_id")
            .select(
                "point_id",
                "tile_id",
                "site",
                "date",
                "sensor",
                "crs",
                F.col("tile_row").cast("long"),
                F.col("tile_col").cast("long"),
                F.col("bbox.bounds").alias("bounds"),
                F.col("cloud_ratio").alias("cloud"),
                F.lit(version).alias("version"),
                "embedding",
            )
        )
        points = checkpointed(points)  # read for both stores
        number = self.points_store.write(points if stored is None else ledger.vector_upsert(stored, points))
        rows = points.select(
            F.col("tile_id").alias("id"),
            F.col("tile_id").alias("image_path"),
            F.lit("unassigned").alias("primary_tag"),
            F.lit(0).alias("cluster"),
            F.lit(0.0).alias("anomaly_score"),
            "sensor",
            "date",
        )
        with self.records.transaction() as t:
            self._upsert_ledger(t, self._keeping_status(rows))
        return number

    def status(self) -> DataFrame:
        return ledger.ingest_status(self.ledger())

    def audit_points(self, prefix: str) -> DataFrame:
        return ledger.point_audit(self.points(), prefix)

    def clean(self, prefix: str) -> int:
        return self.points_store.write(ledger.clean_points(self.points(), prefix))

    # -- search ----------------------------------------------------------------

    def search(self, query: Sequence[float], top_k: int = config.SEARCH_TOP_K, date: str | None = None, sensor: str | None = None) -> DataFrame:
        """Nearest tiles to a query vector (of an image or a text), with positions."""
        hits = search.knn_search(self.points(), query, top_k, date, sensor, tie=("tile_id", "point_id"))
        return geodesy.add_center_wgs84(hits)

    def search_text(self, prompt: str, model: embedding.ModelFactory, top_k: int = config.SEARCH_TOP_K, date: str | None = None, sensor: str | None = None) -> DataFrame:
        """Nearest tiles to a text, embedded by the caller's text model."""
        return self.search(embedding.one_vector(self.spark, prompt, "string", model), top_k, date, sensor)

    def search_image(self, chip: Sequence[float], model: embedding.ModelFactory, top_k: int = config.SEARCH_TOP_K, date: str | None = None, sensor: str | None = None) -> DataFrame:
        """Nearest tiles to an image chip, embedded by the caller's image model."""
        return self.search(embedding.one_vector(self.spark, [float(x) for x in chip], "array<double>", model), top_k, date, sensor)

    def similar(self, tile_id: str, top_k: int = 6, exclude_self: bool = True) -> DataFrame:
        return geodesy.add_center_wgs84(search.similar_tile(self.points(), tile_id, top_k, exclude_self))

    def by_tag(self, tag: str, limit: int = 10) -> DataFrame:
        return search.filter_by_tag(self.ledger(), tag, limit)

    # -- change ----------------------------------------------------------------

    def detect(
        self,
        dates: Sequence[str],
        sensor: str = "Sentinel-2",
        rules: ChangeRules = ChangeRules(),
        enqueue: bool = True,
        model: PipelineModel | None = None,
        matched: DataFrame | None = None,
    ) -> DataFrame:
        """Scene-wide change: all candidates go to the review queue, the top k to the ledger and back.

        `model` gives the confidence, `matched` the second images' vectors after histogram matching.
        """
        found = change.detect_scene_change(self.points(), list(dates), sensor, rules, limit=False, model=model, matched=matched)
        found = checkpointed(change.with_boxes(found, self.points()))
        top = change.change_top_k(found, rules.top_k)
        with self.records.transaction() as t:
            if enqueue:
                added = review.numbered_rows(self.queue(), change.review_rows(found), ["tile_id"], self.now())
                t.upsert("queue", self.spark.createDataFrame([], QUEUE_SCHEMA).unionByName(added, allowMissingColumns=True))
            rows = change.audit_rows(top, sensor).withColumn("image_path", F.col("id"))
            self._upsert_ledger(t, self._keeping_status(rows))
        classifier = config.FALLBACK_LABEL if model is None else "random forest"
        return change.describe_candidates(top, sensor, classifier)

    def detect_tile(
        self,
        tile_id: str,
        dates: Sequence[str],
        rules: ChangeRules = ChangeRules(),
        model: PipelineModel | None = None,
        matched: DataFrame | None = None,
    ) -> DataFrame:
        return change.detect_tile_change(self.points(), self.queue(), tile_id, list(dates), rules, model=model, matched=matched)

    # -- review ----------------------------------------------------------------

    def review_list(self, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return review.review_page(self.queue(), status, limit, offset)

    def review_after(self, created_at: object, item_id: int, status: str | None = None, limit: int = 100) -> DataFrame:
        return review.review_after(self.queue(), created_at, item_id, status, limit)

    def review_change(self, updates: DataFrame) -> None:
        empty = self.spark.createDataFrame([], QUEUE_SCHEMA)
        self.records.merge("queue", updates, lambda old, new: review.review_update(empty if old is None else old, new, self.now()))

    def hotspots(self, limit: int = 100) -> DataFrame:
        payload = self.points().withColumn("cloud_cover", F.lit(None).cast("double"))
        listed = hotspots.hotspot_list(self.ledger(), payload, self.extent, limit)
        return hotspots.with_factors(listed, self.queue())

    def decide(self, decisions: DataFrame) -> None:
        with self.records.transaction() as t:
            mirror = hotspots.mirrored_rows(self.ledger(), self.queue(), decisions)
            t.merge("ledger", decisions, lambda old, new: self.ledger() if old is None else ledger.status_update(old, new))
            t.merge("queue", mirror, lambda old, new: self.queue() if old is None else hotspots.mirror_decisions(old, new))

    def provenance(self, spectral: DataFrame, date_first: str, date_last: str, **how: object) -> DataFrame:
        """Documents of all items; `how` says how vectors were made (model, dimension, histogram_matched)."""
        quality = self.points().select("tile_id", "cloud")
        stamp = F.date_format(self.now(), "yyyy-MM-dd'T'HH:mm:ss")
        queue, audit = self.queue(), self.ledger()
        changes = audit.filter(F.col("primary_tag") != "unassigned")
        items = queue.unionByName(provenance.audit_items(changes, queue))
        # Interim scenes decide about the earliest date; the dates of scenes are few.
        scenes = self.points().select("date", F.col("date").alias("scene_id")).distinct()
        dates = [r["date"] for r in change.scene_sequence(scenes, date_first, date_last).select("date").distinct().orderBy("date").collect()]
        history = change.cell_history(self.points(), sorted({date_first, date_last, *dates}))
        earliest = history.select(F.concat("t1_tile_id", F.lit("__"), "t2_tile_id").alias("tile_id"), "earliest_change")
        return provenance.provenance_doc(
            items, audit, quality, spectral, date_first, date_last, stamp, earliest=earliest, **how
        )

    def export(self, documents: DataFrame, folder: str) -> None:
        write_documents(provenance.provenance_export(documents), folder)

    # -- discovery -------------------------------------------------------------

    def discover(self, prefix: str, starts: discovery.Model, themes) -> dict[str, DataFrame] | None:
        return discovery.discovery_report(self.points(), prefix, starts, themes)

    def insights(self, n_clusters: int = 3) -> dict[str, DataFrame] | None:
        return learning.ml_insights_report(self.points(), "point_id", n_clusters)
