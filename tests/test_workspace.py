"""From pixels to decisions on the planted scenes, and streaming feeds."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.fixtures import planted_scenes
from tests.test_raster import BANDS, SIZE, pixel_table, scene_table
from tilescope.config import ChangeRules, SceneExtent
from tilescope.operators import ledger
from tilescope.operators.embedding import BandHistogramEmbedder
from tilescope.sources import tables
from tilescope.sources.stores import VersionedTable
from tilescope.streaming import feeds
from tilescope.workspace import Workspace
from tests.conftest import ROOT

EXTENT = SceneExtent(19.28, 72.72, 0.43, 0.33)
DATES = ["2024-05-15", "2024-09-20"]


@pytest.fixture(scope="module")
def work(spark):
    place = Workspace(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), EXTENT)
    place.ingest(pixel_table(spark, planted_scenes(SIZE)), scene_table(spark), BANDS, BandHistogramEmbedder(3), SIZE)
    return place


def test_end_to_end(spark, work):
    status = work.status().first()
    assert (status.tile_count, status.anomalies_detected, status.date_range) == (8, 0, "2024-05-15 to 2024-09-20")

    top = work.detect(DATES, rules=ChangeRules(drift_threshold=0.05, confidence_threshold=0.2)).collect()
    assert len(top) == 3 and [r.drift for r in top] == sorted((r.drift for r in top), reverse=True)
    assert all(r.earliest_change == DATES[1] for r in top)
    queue = work.review_list("PENDING").collect()
    assert sorted(r.id for r in queue) == [1, 2, 3]
    assert work.queue().count() == 3

    # Running detection again appends again: the queue has no uniqueness rule, the ledger does.
    work.detect(DATES, rules=ChangeRules(drift_threshold=0.05))
    assert sorted(r.id for r in work.queue().collect()) == [1, 2, 3, 4, 5, 6]
    assert work.ledger().count() == 11

    spots = work.hotspots().collect()
    assert len(spots) == 3 and all(18 < r.lat < 20 and 72 < r.lng < 74 for r in spots)

    chosen = spots[0].id
    work.decide(spark.createDataFrame([(chosen, "Accepted")], "id string, new_status string"))
    assert work.ledger().filter(F.col("id") == chosen).first().status == "Accepted"
    mirrored = work.queue().filter(F.col("tile_id") == chosen).orderBy("id").collect()
    assert mirrored[0].status == "CONFIRMED" and mirrored[0].remarks == "Analyst triage decision: Accepted"
    assert mirrored[1].status == "PENDING"

    # A third run of detection leaves the analyst's word, and candidates carry boxes and paths.
    work.detect(DATES, rules=ChangeRules(drift_threshold=0.05), enqueue=False)
    kept = work.ledger().filter(F.col("id") == chosen).first()
    assert kept.status == "Accepted" and kept.before_image_path == chosen.split("__")[0]
    assert work.queue().filter("bbox_json IS NULL").count() == 0

    chip = [0.5] * (SIZE * SIZE * 3)
    assert work.search_image(chip, BandHistogramEmbedder(3), 2).count() == 2

    # A decided tile that is ingested again keeps its status and its created_at.
    tile = "s1_r0_c0_2024-05-15"
    work.decide(spark.createDataFrame([(tile, "reject")], "id string, new_status string"))
    before = work.ledger().filter(F.col("id") == tile).first()
    work.ingest(pixel_table(spark, planted_scenes(SIZE)), scene_table(spark), BANDS, BandHistogramEmbedder(3), SIZE)
    after = work.ledger().filter(F.col("id") == tile).first()
    assert (after.status, after.created_at) == ("reject", before.created_at)
    assert work.points().count() == 8

    found = work.similar(f"{tile}__s2_r0_c0_2024-09-20", 3).collect()
    assert len(found) == 3 and tile not in [r.tile_id for r in found]
    query = work.points().filter(F.col("tile_id") == tile).first().embedding
    best = work.search(query, 2, sensor="Sentinel-2").collect()
    assert best[0].tile_id == tile and abs(best[0].score - 1) < 1e-9
    assert work.search(query, 2, sensor="Landsat 8").count() == 0
    with pytest.raises(LookupError):
        work.similar("no_such_tile")


def test_export_and_discovery(spark, work):
    if work.queue().count() == 0:
        work.detect(DATES, rules=ChangeRules(drift_threshold=0.05))
    names = [f"{n}_{s}" for n in ("ndvi", "ndbi", "ndwi") for s in ("t1", "t2", "change")]
    none = spark.createDataFrame([], "tile_id string, " + ", ".join(f"{n} double" for n in names))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/docs"
    work.export(work.provenance(none, *DATES), folder)
    lines = spark.read.json(folder)
    assert lines.count() == work.queue().count()
    steps = lines.select("processing_steps.*").first()
    assert steps["histogram_matching_applied"] is None and steps["openclip_model_version"] is None
    assert {r[0] for r in lines.select("metrics_and_classification.exact_7_features.days_between").collect()} == {128}

    vectors = [list(r.embedding) for r in work.points().orderBy("tile_id").limit(4).collect()]
    report = work.discover("s", vectors, [("one", vectors[0]), ("two", vectors[1])])
    assert report["points"].count() == 8
    assert sum(r.tile_count for r in report["clusters"].collect()) == 8
    ends = report["points"].agg(F.min("x"), F.max("x")).first()
    assert abs(ends[0] + 100) < 1e-9 and abs(ends[1] - 100) < 1e-9
    assert work.discover("nowhere_", vectors, []) is None


def test_stream_equals_batch(spark):
    feed = tables.view(spark, ROOT, "audit_changes")
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(3):  # three files, in time order
        days = F.dayofyear("ts") % 3
        feed.filter(days == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/ledger")
    marks = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def merge(stored, batch):
        # Order-free columns: the day slices overlap in time, so only these must agree with one batch.
        seen = batch.groupBy("id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
        if stored is None:
            return seen
        both = stored.unionByName(seen)
        return both.groupBy("id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))

    feeds.stream_into(stream, store, merge, marks).awaitTermination()
    want = feed.groupBy("id").agg(F.min("ts"), F.max("ts"), F.count("*")).collect()
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want))
    assert len(store.versions()) == 3


def test_stream_after_batch_writes(spark):
    """Versions written before stay, the stream's rows are added, and a batch counts once."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = VersionedTable(spark, folder + "/t")
    store.write(spark.range(2))
    store.update(lambda old: old.unionByName(spark.range(2, 4)))
    source = folder + "/in"
    spark.range(10, 13).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    merge = lambda stored, batch: batch if stored is None else stored.unionByName(batch)
    feeds.stream_into(stream, store, merge, folder + "/marks").awaitTermination()
    assert store.versions() == [0, 1, 2] and store.read(0).count() == 2
    assert sorted(r.id for r in store.read().collect()) == [0, 1, 2, 3, 10, 11, 12]
    assert store.has_batch(folder + "/marks", 0) and not store.has_batch("other", 0)


def test_audit_stream_is_idempotent(spark):
    feed = tables.view(spark, ROOT, "audit_changes")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    early, late = feed.filter(F.col("ts") < cut), feed.filter(F.col("ts") >= cut)
    merge = feeds.merge_audit(["ts", "event_id"])
    once = merge(merge(None, early), late)
    again = merge(once, late)
    whole = ledger.reduce_feed(feed, ["ts", "event_id"])
    cols = sorted(whole.columns)
    assert once.select(cols).exceptAll(whole.select(cols)).isEmpty()
    assert again.select(cols).exceptAll(whole.select(cols)).isEmpty()


def test_stream_with_an_emptied_checkpoint(spark):
    """Its batches begin at 0 again; they are another stream's and are merged, once."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store, marks = VersionedTable(spark, folder + "/store"), folder + "/marks"
    # What the stream before left under the same checkpoint folder:
    store.write(spark.createDataFrame([(1,)], "id long"), source=marks, batch=0, stream="id of the stream before")
    spark.createDataFrame([(2,)], "id long").write.parquet(folder + "/in")
    stream = spark.readStream.schema("id long").parquet(folder + "/in")
    for _ in range(2):
        feeds.stream_into(stream, store, lambda old, new: old.unionByName(new), marks).awaitTermination()
    assert sorted(r["id"] for r in store.read().collect()) == [1, 2]
    assert store.has_batch(marks, 0, feeds.stream_id(spark, marks)) and not store.has_batch(marks, 0, "another")
