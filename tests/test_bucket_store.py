"""Keyed updates in buckets: what is written, what is read, conflicts, schemas, and commits of two tables."""

import pytest
from pyspark.sql import functions as F

from tilescope.operators import ledger
from tilescope.sources import bucket_store
from tilescope.sources.bucket_store import BucketStore, Conflict


def rows(spark, ids, value, kind="id long, value string"):
    return spark.createDataFrame([(i, value) for i in ids], kind)


def content(store, table="t"):
    return {r["id"]: r["value"] for r in store.read(table).collect()}


@pytest.fixture
def store(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "id", "u": "id"}, buckets=8)
    with store.transaction() as t:
        t.upsert("t", rows(spark, range(200), "a"))
    return store


def id_in(store, spark, bucket):
    df = spark.range(1000).filter(store.bucket_of(F.col("id")) == bucket)
    return [r["id"] for r in df.orderBy("id").limit(2).collect()]


def test_an_update_of_one_id_writes_one_bucket(spark, store):
    before = store.state()["tables"]["t"]["files"]
    store.merge("t", rows(spark, [7], "b"), lambda old, new: new)
    after = store.state()["tables"]["t"]["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    (delta,) = [after[b][-1] for b in before if before[b] != after[b]]
    assert spark.read.parquet(f"{store.folder}/{delta}").count() == 1
    assert content(store) == {i: "b" if i == 7 else "a" for i in range(200)}
    assert store.read("t", version=0).filter("value = 'b'").count() == 0


def test_compaction_keeps_the_newest_rows(spark, store, monkeypatch):
    monkeypatch.setattr(bucket_store, "MOST_DELTAS", 2)
    for turn in range(5):
        store.merge("t", rows(spark, [3, 500 + turn], f"v{turn}"), lambda old, new: new)
        assert max(map(len, store.state()["tables"]["t"]["files"].values())) <= 2
    assert content(store) == {**{i: "a" for i in range(200)}, 3: "v4", **{500 + k: f"v{k}" for k in range(5)}}


def test_writers_on_different_buckets_both_commit(spark, store):
    one, two = id_in(store, spark, 1), id_in(store, spark, 2)
    with store.transaction() as slow:
        slow.merge("t", rows(spark, one, "slow"), lambda old, new: new)
        store.merge("t", rows(spark, two, "fast"), lambda old, new: new)
    assert store.versions() == [0, 1, 2]
    found = content(store)
    assert {found[i] for i in one} == {"slow"} and {found[i] for i in two} == {"fast"}


def test_writers_on_the_same_bucket_conflict(spark, store):
    one = id_in(store, spark, 1)
    with pytest.raises(Conflict):
        with store.transaction() as slow:
            slow.merge("t", rows(spark, one[:1], "slow"), lambda old, new: new)
            store.merge("t", rows(spark, one[1:], "fast"), lambda old, new: new)
    assert store.versions() == [0, 1] and "slow" not in content(store).values()


def test_two_tables_commit_together_or_not_at_all(spark, store):
    with store.transaction() as t:
        t.merge("t", rows(spark, [1], "both"), lambda old, new: new)
        t.upsert("u", rows(spark, [9], "both"))
    assert store.versions() == [0, 1] and content(store)[1] == "both" and content(store, "u") == {9: "both"}
    with pytest.raises(ZeroDivisionError):
        with store.transaction() as t:
            t.merge("t", rows(spark, [1], "lost"), lambda old, new: new)
            1 / 0
    assert store.versions() == [0, 1] and content(store)[1] == "both"
    assert store.read("u", version=0) is None


def test_a_version_without_columns_reads_and_upserts(spark, tmp_path):
    """Older files lack columns and have narrow numbers; they are read as they should be now, and rows with all columns join them."""
    store = BucketStore(spark, str(tmp_path / "s"), {"ledger": "id"}, buckets=4)
    narrow = "id string, status string, cluster int, anomaly_score float"
    with store.transaction() as t:
        t.upsert("ledger", spark.createDataFrame([(f"a{k}", "pending", k, 0.5) for k in range(20)], narrow))
    with store.transaction() as t:
        t.evolve("ledger", "cluster long, anomaly_score double, sensor string, date string, created_at timestamp")
    feed = spark.createDataFrame([("a3", "seen", 2**40, 0.25, "S", "note"), ("new", "x", 1, 1.0, None, None)], "id string, status string, cluster long, anomaly_score double, sensor string, before_desc string")
    store.merge("ledger", feed.withColumn("at", F.lit("2024-01-01").cast("timestamp")), lambda old, new: ledger.audit_upsert(old, new, ["at"]))
    found = {r["id"]: r for r in store.read("ledger").collect()}
    assert len(found) == 21 and found["a3"]["cluster"] == 2**40 and found["a3"]["sensor"] == "S"
    assert found["a3"]["before_desc"] == "note" and found["a4"]["before_desc"] is None
    assert found["a4"]["cluster"] == 4 and found["a4"]["sensor"] is None and found["a4"]["anomaly_score"] == 0.5
    with store.transaction() as t:
        t.upsert("ledger", feed.limit(1).withColumn("extra", F.lit(1)))
    assert {r["id"] for r in store.read("ledger").filter("extra = 1").collect()} == {"a3"}
    assert "extra" not in store.read("ledger", version=2).columns


def test_batches_of_a_stream_count_once(spark, store):
    for _ in range(2):
        with store.transaction() as t:
            if not t.seen("feed", 0):
                t.upsert("t", rows(spark, [300], "once"))
    assert store.versions() == [0, 1] and content(store)[300] == "once"


def test_rows_without_a_key_are_refused(spark, store):
    with pytest.raises(Exception, match="no key"):
        store.merge("t", rows(spark, [None], "x"), lambda old, new: new)
    with pytest.raises(Exception, match="no key"):
        with store.transaction() as t:
            t.upsert("t", rows(spark, [None], "x"))
    assert store.versions() == [0]
    store.merge("t", rows(spark, [], "x"), lambda old, new: new)
    assert len(content(store)) == 200


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """Sixteen small pieces of one bucket, far more than a task should hold by the setting: more files than one, the same rows."""
    store = BucketStore(spark, str(tmp_path / "big"), {"t": "id"}, buckets=1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        with store.transaction() as t:
            t.upsert("t", spark.range(0, 60000, 1, 16).withColumn("value", F.sha2(F.col("id").cast("string"), 256)))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (path,) = store.state()["tables"]["t"]["files"]["0"]
    assert len(spark.read.parquet(f"{store.folder}/{path}").inputFiles()) > 3
    assert store.read("t").distinct().count() == 60000
