"""Identifiers, geometry, ranks and order statistics, change rules and stores."""

import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.config import ChangeRules
from tilescope.functions import geodesy, identity, vectors
from tilescope.functions.ranking import exact_quantile, join_small, top_per_key, with_global_rank
from tilescope.operators import change, hotspots, ledger, review, search, tiling
from tilescope.sources.stores import VersionedTable, read_rasters


def test_point_id_is_a_version_5_uuid(spark):
    ids = ["scene_r0_c0_2024-01-01", "x", "ünïcode", "a__b"]
    rows = spark.createDataFrame([(i,) for i in ids], "t string").select("t", identity.point_id(F.col("t")).alias("p"))
    for r in rows.collect():
        assert r.p == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.t))
    blank = spark.createDataFrame([("",), (None,)], "t string").select(identity.point_id(F.col("t")).alias("p")).collect()
    assert {uuid.UUID(r.p).version for r in blank} == {4}


def test_utm_sample_and_round_trip(spark):
    rows = spark.createDataFrame(
        [([274120.0, 2110590.0, 276680.0, 2113150.0], "EPSG:32643"), ([10.0, 20.0, 12.0, 22.0], "epsg:4326 "), (None, "EPSG:32643")],
        "bounds array<double>, crs string",
    )
    got = geodesy.add_center_wgs84(rows).collect()
    assert abs(got[0].lat - 19.08742911597383) < 1e-9 and abs(got[0].lng - 72.86530447410439) < 1e-9
    assert (got[1].lat, got[1].lng) == (21.0, 11.0)
    assert (got[2].lat, got[2].lng) == (0.0, 0.0)
    there = geodesy.degrees_to_utm(F.lit(19.08742911597383), F.lit(72.86530447410439), F.lit(32643))
    x, y = spark.range(1).select(there[0].alias("x"), there[1].alias("y")).first()
    assert abs(x - 275400) < 1e-3 and abs(y - 2111870) < 1e-3
    south = geodesy.utm_to_degrees(F.lit(500000.0), F.lit(10000000.0), F.lit(32731))
    lat, lng = spark.range(1).select(south.alias("s")).select("s.*").first()
    assert abs(lat) < 1e-9 and abs(lng - 3) < 1e-9


def test_unknown_projection_is_an_error(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0], "EPSG:2154")], "bounds array<double>, crs string")
    with pytest.raises(Exception, match="no projection"):
        geodesy.add_center_wgs84(rows).collect()


def test_vector_rules(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<double>, b array<double>")
    got = rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].c == 0.0 and abs(got[1].c - 1) < 1e-12
    assert rows.select(vectors.drift(vectors.cosine(F.col("a"), F.col("b"))).alias("d")).first().d == 1.0
    zero = rows.select(vectors.unit(F.col("b")).alias("u")).first().u
    assert list(zero) == [0.0, 0.0]
    batch = rows.select(vectors.cosine_to(F.col("b"), [[1.0, 1.0], [0.0, 0.0]]).alias("c")).collect()
    assert list(batch[0].c) == [0.0, 0.0] and abs(batch[1].c[0] - 14 / np.sqrt(200)) < 1e-12
    with pytest.raises(ValueError):
        vectors.cosine_to(F.col("a"), [])


def test_small_text_rules(spark):
    rows = spark.createDataFrame(
        [("Accepted", "0.4"), ("REJECT", "7"), ("flag", "-1"), ("whatever", "abc"), ("PENDING", None)], "s string, v string"
    )
    got = rows.select(identity.normalise_status(F.col("s")), identity.decision_display(F.col("s")), identity.clamp_confidence(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        ("CONFIRMED", "accepted", 0.4),
        ("REJECTED", "reject", 1.0),
        ("FLAGGED", "flag", 0.0),
        ("PENDING", "whatever", 0.0),
        ("PENDING", "pending", 0.0),
    ]
    days = spark.createDataFrame([("2024-01-01T05:00", "2023-12-02"), ("garbage", "2024-03-01"), (None, None)], "a string, b string")
    got = days.select(*identity.date_features(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(30, 1, 12), (30, 1, 3), (30, 1, 1)]
    sensors = spark.createDataFrame([("Sentinel-2 (L2A)",), ("Landsat 9",), ("Sentinel-1",), (None,)], "s string")
    assert sensors.filter(search.sensor_family(F.col("s"), ["Sentinel-2"])).count() == 1
    assert sensors.filter(search.sensor_family(F.col("s"), ["landsat", "el-1"])).count() == 2
    assert sensors.filter(search.sensor_family(F.col("s"), [])).count() == 0
    dates = spark.createDataFrame([("2024-01-01",), ("",), (None,), ("2025-01-01",)], "d string")
    assert dates.filter(search.date_range(F.col("d"), "2024-01-01", "2024-06-01")).count() == 3
    assert dates.filter(search.date_range(F.col("d"), "2024-06-01", "2024-01-01")).count() == 4


# -- ranks and order statistics ------------------------------------------------


def skewed(spark, n=30_000):
    """A table where one key holds most rows and one value repeats heavily."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.when(F.col("id") % 4 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7).alias("v"),
    )


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.95, 0.98, 1.0])
def test_exact_quantile_equals_numpy(spark, share):
    df = skewed(spark)
    got = {r.key: r.q for r in exact_quantile(df, ["key"], "v", lambda n: (n - 1) * share, "q").collect()}
    pdf = df.toPandas()
    for key, group in pdf.groupby("key"):
        assert abs(got[key] - np.percentile(group.v, share * 100)) < 1e-9
    whole = exact_quantile(df, [], "v", lambda n: (n - 1) * share, "q").first()
    assert whole.n_values == len(pdf) and abs(whole.q - np.percentile(pdf.v, share * 100)) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 11, 250])
def test_exact_quantile_of_few_values(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    for share in (0.0, 0.1, 0.5, 1.0):
        got = exact_quantile(df, [], "v", lambda m: (m - 1) * share, "q").first().q
        assert abs(got - np.percentile([i * i for i in range(n)], share * 100)) < 1e-9
    p95 = exact_quantile(df, [], "v", lambda m: F.greatest(F.floor(m * 0.95) - 1, F.lit(0)), "q").first().q
    assert p95 == sorted(i * i for i in range(n))[max(0, int(0.95 * n) - 1)]


def test_global_rank_is_gapless_and_ordered(spark):
    df = skewed(spark).select("key", "id")
    ranked = with_global_rank(df, ["key", "id"], "rank").toPandas().sort_values("rank")
    assert ranked["rank"].tolist() == list(range(1, len(ranked) + 1))
    assert ranked[["key", "id"]].values.tolist() == ranked.sort_values(["key", "id"])[["key", "id"]].values.tolist()
    empty = with_global_rank(df.filter("id < 0"), ["key", "id"], "rank")
    assert empty.count() == 0


def test_top_per_key_limits_before_the_shuffle(spark):
    best = top_per_key(skewed(spark), ["key"], [F.col("v").desc(), F.col("id")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    before = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[before:], "each task must cut a hot key down before shuffling"
    assert best.count() == skewed(spark).select("key").distinct().count()


# -- change --------------------------------------------------------------------


def tile(date, row=0, col=0, vec=(1.0, 0.0), cloud=0.0, sensor="Sentinel-2", point="p"):
    return (f"{point}{date}{row}{col}", f"t_r{row}_c{col}_{date}", "aoi", date, sensor, row, col, cloud, [float(v) for v in vec])


def tile_table(spark, rows):
    return spark.createDataFrame(
        rows,
        "point_id string, tile_id string, site string, date string, sensor string, tile_row long, tile_col long, "
        "cloud double, embedding array<double>",
    )


DATES = ["2024-01-01", "2024-06-01", "2024-12-01"]
RULES = ChangeRules(drift_threshold=0.1, confidence_threshold=0.5, calibration=1.0)


def history(spark, rows, **kw):
    out = change.cell_history(tile_table(spark, rows), DATES, None, RULES, **kw).collect()
    return {(r.tile_row, r.tile_col): r for r in out}


def test_earliest_change_takes_the_first_crossing(spark):
    a, b, c = DATES
    got = history(spark, [tile(a), tile(b, vec=(0, 1)), tile(c, vec=(1, 0))])[(0, 0)]
    assert got.earliest_change == b and [i.threshold_crossed for i in got.intervals] == [True, True]
    assert [i.interval for i in got.intervals] == ["T1->T2", "T2->T3"]
    assert got.intervals[0].pair == f"{a} -> {b}"


def test_earliest_change_falls_back_to_the_whole_span(spark):
    a, b, c = DATES
    # The middle scene is clouded: both intervals are suppressed, the span is not.
    got = history(spark, [tile(a), tile(b, cloud=0.9), tile(c, vec=(0, 1))])[(0, 0)]
    assert [i.suppression_reason for i in got.intervals] == ["T2 cloud/shadow contamination", "T1 cloud/shadow contamination"]
    assert [i.raw_drift for i in got.intervals] == [0.0, 1.0]
    assert got.earliest_change == c and not got.suppressed
    # With two dates there is no fallback; a suppressed first tile suppresses the span.
    two = history(spark, [tile(a, cloud=0.9), tile(c, vec=(0, 1))])[(0, 0)]
    assert two.earliest_change is None and (two.drift, two.similarity, two.confidence) == (0.0, 1.0, 0.0)


def test_cells_without_a_partner_are_no_candidates(spark):
    a, _, c = DATES
    rows = [tile(a), tile(c, vec=(0, 1)), tile(a, row=256), tile(c, col=256)]
    found = change.detect_scene_change(tile_table(spark, rows), DATES, None, RULES).collect()
    assert [(r.tile_row, r.tile_col) for r in found] == [(0, 0)]


def test_repeats_and_sensor_preference(spark):
    a, _, c = DATES
    rows = [tile(a), tile(a, vec=(0, 1), point="z"), tile(c, vec=(0, 1)), tile(c, sensor="Landsat 8", point="a")]
    table = tile_table(spark, rows)
    assert change.detect_scene_change(table, DATES, "Sentinel-2", RULES).first().drift == 1.0
    # Landsat is stored, so only it is compared; an unknown sensor falls back to the date.
    assert change.detect_scene_change(table, DATES, "Landsat 8", RULES).count() == 0
    assert change.detect_scene_change(table, DATES, "Other", RULES).count() == 0
    pairs = change.tile_pair_join(table, a, c, "Other", ["point_id"])
    assert {r.point_id_t2[0] for r in pairs.collect()} == {"a"}


def test_a_cell_with_very_many_copies_leaves_tasks_as_one_row(spark):
    a, _, c = DATES
    base = tile_table(spark, [tile(a), tile(c, vec=(0, 1)), tile(a, row=256), tile(c, row=256, vec=(0, 1))])
    copies = base.filter("tile_row = 0").crossJoin(spark.range(3000)).withColumn("point_id", F.concat("point_id", F.lit("-"), "id")).drop("id")
    rows = base.unionByName(copies).repartition(16)
    found = change.detect_scene_change(rows, DATES, None, RULES)
    assert [r.drift for r in found.collect()] == [1.0, 1.0]
    initial = found._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min" in initial, "copies must combine before the shuffle"
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(site") == 1, "the whole history is one shuffle by cell"
    one = change.detect_scene_change(rows.coalesce(1), DATES, None, RULES)
    assert sorted(map(str, one.collect())) == sorted(map(str, found.collect()))


# -- hotspots, ledger, review, stores ------------------------------------------


def test_nearest_hotspot_equals_brute_force_in_a_crowded_square(spark):
    rng = np.random.default_rng(3)
    crowd = np.column_stack([10.2 + rng.normal(0, 0.004, 400), 20.2 + rng.normal(0, 0.004, 400)])
    spread = np.column_stack([rng.uniform(9, 12, 60), rng.uniform(19, 22, 60)])
    places = np.vstack([crowd, crowd[:5], spread])
    clicks = np.vstack([crowd[:50] + rng.normal(0, 0.01, (50, 2)), rng.uniform(9, 22, (60, 2)), [[10.5, 20.5]]])
    spots = spark.createDataFrame([(f"h{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(places)], "id string, lat double, lng double")
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(clicks)], "click_id int, lat double, lng double")
    got = {r.click_id: (r.id, r.distance) for r in hotspots.nearest_hotspot(asked, spots).collect()}
    for i, c in enumerate(clicks):
        distance = np.sqrt(((places - c) ** 2).sum(axis=1))
        best = distance.min()
        if best > 0.5:
            assert i not in got
            continue
        # The last of equally near hotspots wins.
        assert got[i][0] == f"h{np.flatnonzero(distance == best)[-1]:04d}" and abs(got[i][1] - best) < 1e-12


def test_audit_upsert_keeps_known_values(spark):
    schema = "id string, image_path string, status string, sensor string, date string, at timestamp, n int"
    feed = spark.createDataFrame(
        [("a", "1", "pending", "S2", "2024", None, 1), ("a", "2", "accepted", None, None, None, 2), ("b", "3", "pending", None, "2023", None, 3)],
        schema,
    ).withColumn("at", F.timestamp_seconds("n"))
    first = ledger.audit_upsert(ledger.reduce_feed(feed.filter("n < 2"), ["at", "n"]), feed.filter("n >= 2"), ["at", "n"])
    rows = {r.id: r for r in first.collect()}
    assert (rows["a"].image_path, rows["a"].status, rows["a"].sensor, rows["a"].date) == ("2", "accepted", "S2", "2024")
    assert rows["a"].created_at.second == 1 and rows["b"].sensor is None
    status = ledger.ingest_status(spark.createDataFrame([], "primary_tag string, anomaly_score double, date string, sensor string")).first()
    assert (status.tile_count, status.date_range, list(status.sensors)) == (0, "No data ingested yet", ["Sentinel-2"])


def test_bad_review_updates_are_errors(spark):
    queue = spark.createDataFrame([(1, "PENDING", 0.5, None, None)], "id long, status string, confidence double, remarks string, updated_at timestamp")
    shape = "id long, new_status string, new_confidence double, new_remarks string"
    for bad in ((1, None, None, None), (1, "MAYBE", None, None), (1, None, 1.5, None)):
        with pytest.raises(Exception, match="invalid review update"):
            review.review_update(queue, spark.createDataFrame([bad], shape), F.current_timestamp()).collect()
    good = spark.createDataFrame([(1, None, None, "seen"), (9, "FLAGGED", None, None)], shape)
    row = review.review_update(queue, good, F.current_timestamp()).first()
    assert (row.status, row.confidence, row.remarks) == ("PENDING", 0.5, "seen") and row.updated_at is not None


def test_points_are_classified_once_per_tile(spark):
    rows = [("p1", "aoi_x"), ("p2", "aoi_x"), ("p3", "test_y"), ("p4", ""), ("p5", None), ("p6", "aoi_z")]
    points = spark.createDataFrame(rows, "point_id string, tile_id string")
    states = {r.point_id: r.state for r in ledger.classify_points(points, "aoi_").collect()}
    assert states == {"p1": "valid", "p2": "repeated", "p3": "stale", "p4": "stale", "p5": "stale", "p6": "valid"}
    assert tuple(ledger.point_audit(points, "aoi_").first()) == (6, 2, 3, 1)


def test_dedupe_keeps_blank_ids(spark):
    hits = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("", 0.2), ("", 0.2), (None, 0.3)], "tile_id string, score double")
    got = sorted((r.tile_id or "", r.score) for r in search.dedupe_hits(hits).collect())
    assert got == [("", 0.2), ("", 0.2), ("", 0.3), ("a", 0.9)]


def test_search_returns_k_tiles_however_often_they_repeat(spark):
    rows = [(f"p{i:03d}", "best", [1.0, 0.0]) for i in range(200)]
    rows += [("q1", "second", [1.0, 0.1]), ("q2", "third", [0.0, 1.0]), ("q3", "gone", None)]
    points = spark.createDataFrame(rows, "point_id string, tile_id string, embedding array<double>")
    got = search.knn_search(points, [1.0, 0.0], 3, tie=("tile_id", "point_id")).collect()
    assert [(r.tile_id, r.point_id) for r in got] == [("best", "p000"), ("second", "q1"), ("third", "q2")]
    assert search.knn_search(points, [1.0, 0.0], 3, unique=False).filter("tile_id = 'best'").count() == 3


def test_versions_never_overwrite_what_is_read(spark):
    store = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t")
    assert store.read() is None and store.versions() == []
    store.write(spark.range(3))
    store.update(lambda old: old.unionByName(spark.range(3, 5)))
    assert store.versions() == [0, 1]
    assert store.read().count() == 5 and store.read(0).count() == 3


def test_uncommitted_and_taken_versions(spark):
    store = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t")
    store.write(spark.range(3))
    spark.range(9).write.parquet(f"{store.folder}/data/left-by-a-failed-writer")
    assert store.versions() == [0] and store.read().count() == 3
    with pytest.raises(ValueError):
        store.write(spark.range(1), version=0)
    assert store.read().count() == 3


def test_global_rank_with_nulls(spark):
    rows = spark.createDataFrame([(None,), ("b",), ("a",), ("c",)], "k string").repartition(3)
    ranked = {r.k: r.n for r in with_global_rank(rows, ["k"], "n").collect()}
    assert ranked == {None: 1, "a": 2, "b": 3, "c": 4}


def test_quantile_slices_stay_small(spark):
    """What the last window holds does not grow with the distinct values of a bracket."""
    rows = spark.range(300_000).select((F.xxhash64("id") % 10**9).cast("double").alias("v"))
    got = exact_quantile(rows, [], "v", lambda n: (n - 1) * 0.85, "q").first()
    values = np.sort(rows.toPandas()["v"].to_numpy())
    assert got.n_values == 300_000 and abs(got.q - np.quantile(values, 0.85)) < 1e-6


def test_join_small_in_both_ways(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        sent = sorted(join_small(big, small, ["k"]).collect())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_small(big, small, ["k"])
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(joined.collect()) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_zones_and_mercator(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 111319.490793, 0.0], "EPSG:3857")], "bounds array<double>, crs string")
    got = geodesy.add_center_wgs84(rows).first()
    assert abs(got.lng - 0.5) < 1e-6 and abs(got.lat) < 1e-9
    with pytest.raises(Exception, match="no projection"):
        geodesy.add_center_wgs84(rows.withColumn("crs", F.lit("EPSG:32661"))).collect()


def test_scene_pairs_by_order(spark):
    scenes = spark.createDataFrame([(10, "s", "c", 1, 1, [1.0]), (20, "s", "c", 1, 1, [1.0]), (15, "t", "c", 1, 1, [1.0])],
                                   "scene_id int, site string, crs string, width int, height int, affine array<double>")
    got = tiling.pair_readiness(scenes).collect()
    assert [(r.scene_id_a, r.scene_id_b, r.ready) for r in got] == [(10, 20, True)]


def test_pages_by_key_equal_pages_by_offset(spark):
    queue = spark.range(40).select("id", F.lit("PENDING").alias("status"), F.timestamp_seconds(F.col("id") % 6).alias("created_at"))
    first = review.review_page(queue, "PENDING", 7).collect()
    second = review.review_after(queue, first[-1].created_at, first[-1].id, "PENDING", 7).collect()
    assert second == review.review_page(queue, "PENDING", 7, 7).collect()


def test_aoi_window_is_clamped(spark):
    scenes = spark.createDataFrame([(1, 100, 100, [10.0, 0.0, 0.0, 0.0, -10.0, 1000.0])], "scene_id int, width int, height int, affine array<double>")
    for x, y, want in ((500.0, 500.0, (40, 40)), (0.0, 1000.0, (0, 0)), (999.0, 1.0, (80, 80))):
        row = tiling.aoi_windows(scenes, F.lit(x), F.lit(y), 20).first()
        assert (row.row_off, row.col_off) == want


def test_raster_files_are_decoded_in_parallel(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    scenes = {i: np.random.default_rng(i).integers(0, 255, (4, 6)).astype("uint8") for i in range(3)}
    for i, scene in scenes.items():
        np.save(f"{folder}/scene_{i}.npy", scene)

    def decode(batches):
        import io

        import numpy
        import pandas

        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                image = numpy.load(io.BytesIO(content))
                y, x = numpy.indices(image.shape)
                number = int(path.rsplit("_", 1)[1].split(".")[0])
                yield pandas.DataFrame({"scene_id": number, "y": y.ravel(), "x": x.ravel(), "v": image.ravel()})

    pixels = read_rasters(spark, folder, decode, "scene_id int, y int, x int, v int", "*.npy")
    got = {(r.scene_id, r.y, r.x): r.v for r in pixels.collect()}
    assert got == {(i, y, x): int(s[y, x]) for i, s in scenes.items() for y in range(4) for x in range(6)}


def test_store_reads_only_the_dates_asked_for(spark):
    store = VersionedTable(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/p", ["date"])
    store.write(spark.createDataFrame([("2024-01-01", 1), ("2024-06-01", 2)], "date string, n int"))
    rows = store.read()
    assert dict(rows.dtypes)["date"] == "string"
    one = rows.filter(F.col("date") == "2024-06-01")
    assert [r.n for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
