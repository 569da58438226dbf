"""Exact search through the stored index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tilescope.operators import search
from tilescope.sources import metric_index
from tilescope.sources.metric_index import MetricIndex

COLUMNS = "point_id string, tile_id string, date string, sensor string, version long, embedding array<float>"


def clustered(seed, n, spread=0.03, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    v = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 16))
    return [
        (f"p{seed}_{k}", f"t{k % (n - 7)}", f"d{k % 3}", f"s{k % 2}", 1, (v[k] * rng.uniform(0.5, 2)).astype("float32").tolist()) for k in range(n)
    ]


ODD = [("z", "zero", "d0", "s0", 1, [0.0] * 16), ("n", "none", "d0", "s0", 1, None), ("b", None, "d1", "s1", 1, [1.0] * 16)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(clustered(1, 4000) + ODD, COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return MetricIndex(spark, str(tmp_path_factory.mktemp("index") / "a")).build(rows, slice_rows=64)


def found(hits):
    return [(r["tile_id"], r["date"], r["score"]) for r in hits.collect()]


def test_equals_the_scan_and_skips_files(rows, index):
    assert index.rows().count() == rows.count()
    n_files = len(index.rows().inputFiles())
    rng = np.random.default_rng(3)
    near = [r["embedding"] for r in rows.filter("embedding is not null").limit(4).collect()]
    shares = []
    for query in [*near, rng.normal(size=16).tolist()]:
        hits = index.search(query, 10, tie=("tile_id", "point_id"))
        assert found(hits) == found(search.knn_search(rows, query, 10, tie=("tile_id", "point_id")))
        shares.append(len(hits.inputFiles()) / n_files)
    assert max(shares[:4]) < 0.2  # a query inside a cluster reads few of the files


def test_filters_and_more_hits_than_rows(rows, index):
    query = [1.0] * 16
    for kwargs in ({"date": "d1", "sensor": "s0"}, {"date": "d9"}):
        want = search.knn_search(rows, query, 7, tie=("tile_id", "point_id"), **kwargs)
        assert found(index.search(query, 7, tie=("tile_id", "point_id"), **kwargs)) == found(want)
    whole = index.search(query, 10_000, tie=("tile_id", "point_id"))
    assert found(whole) == found(search.knn_search(rows, query, 10_000, tie=("tile_id", "point_id")))
    assert found(index.search([0.0] * 16, 5)) == found(search.knn_search(rows, [0.0] * 16, 5))


def test_upsert_writes_touched_slices_only(spark, rows, tmp_path):
    index = MetricIndex(spark, str(tmp_path / "b")).build(rows, slice_rows=64)
    before = index.slices()
    moved = [("p1_5", "t5", "d2", "s1", 2, [9.0] + [0.0] * 15), ("new", "tnew", "d2", "s1", 1, [1.0] * 16), ("p1_6", "t6", "old", "s", 0, [2.0] * 16)]
    feed = spark.createDataFrame(moved, COLUMNS)
    index.upsert(feed)
    after = index.slices()
    assert 0 < (before["path"] != after["path"]).sum() <= 6
    now = search.knn_search
    stored = {r["point_id"]: r for r in index.rows().collect()}
    assert len(stored) == index.rows().count() == rows.count() + 1
    assert stored["p1_5"]["date"] == "d2" and stored["p1_6"]["date"] != "old"
    for query in ([9.0] + [0.0] * 15, [1.0] * 16):
        assert found(index.search(query, 5)) == found(now(index.rows(), query, 5))
    # The version before is still whole.
    assert index.slice_table.read(0).toPandas()["rows"].sum() == rows.count()


def test_copies_and_empty_tables(spark, tmp_path):
    copies = [(f"p{k}", f"t{k}", "d", "s", 1, [1.0, 2.0]) for k in range(500)]
    index = MetricIndex(spark, str(tmp_path / "c")).build(spark.createDataFrame(copies, COLUMNS), slice_rows=50)
    assert [r["tile_id"] for r in index.search([1.0, 2.0], 3).collect()] == ["t0", "t1", "t10"]
    nothing = spark.createDataFrame([], COLUMNS)
    index = MetricIndex(spark, str(tmp_path / "e")).build(nothing)
    assert index.slices()["rows"].sum() == 0
    with pytest.raises(LookupError):
        index.search([1.0, 2.0], 3)
    index.upsert(spark.createDataFrame(copies, COLUMNS))
    assert [r["tile_id"] for r in index.search([1.0, 2.0], 3).collect()] == ["t0", "t1", "t10"]


def test_rows_are_placed_once_and_a_few_at_a_time(spark, rows, index, monkeypatch):
    centres = index.centres()
    bins = index._bins(index.slices())
    placed = index._placed(rows, centres).join(F.broadcast(bins), ["_cell", "_bin"])
    # The adaptive plan's text holds one plan as long as it has not run.
    assert placed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {r["point_id"]: (r["_cell"], r["_bin"]) for r in placed.collect()}
    assert len(want) == rows.count()
    seen = []
    real = metric_index._unit
    monkeypatch.setattr(metric_index, "_unit", lambda m: seen.append(len(m)) or real(m))
    caught = []
    monkeypatch.setattr(metric_index.F, "arrow_udf", lambda kind: lambda f: caught.append(f) or arrow_udf(kind)(f))
    index._placed(rows, centres)
    batch = rows.select("point_id", "embedding").filter("embedding is not null").toArrow().combine_chunks()
    found = np.array(caught[0](batch["embedding"].chunk(0)).to_pylist())
    assert sum(seen) == len(found) == batch.num_rows > 4000 and max(seen) <= 512
    assert [want[p][0] for p in batch["point_id"].to_pylist()] == found[:, 0].astype(int).tolist()
