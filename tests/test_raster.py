import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import pixel_rows, planted_scenes
from tilescope.operators import embedding, matching, quality, spectral, tiling
from tilescope.operators.change import change_pair_score, tile_pair_join

BANDS = ["r", "g", "b", "nir"]
SIZE = 32


def scene_table(spark, ids=(1, 2), height=64, width=64, nodata=None):
    dates = {1: "2024-05-15", 2: "2024-09-20"}
    rows = [
        (i, "aoi", f"s{i}", dates[i], "Sentinel-2", "EPSG:32643", width, height, nodata, [10.0, 0.0, 274120.0, 0.0, -10.0, 2113150.0])
        for i in ids
    ]
    return spark.createDataFrame(
        rows,
        "scene_id int, site string, stem string, date string, sensor string, crs string, width int, height int, "
        "nodata int, affine array<double>",
    )


def pixel_table(spark, scenes):
    return spark.createDataFrame(pixel_rows(scenes), "scene_id int, y int, x int, r int, g int, b int, nir int")


def test_planted_changes_rank_above_the_stable_tile(spark):
    pixels, scenes = pixel_table(spark, planted_scenes(SIZE)), scene_table(spark)
    tiles = tiling.ingest_tiles(pixels, scenes, BANDS, SIZE)
    assert tiles.count() == 8
    chips = embedding.tile_chips(tiling.place_in_windows(pixels, SIZE, SIZE), tiling.TILE_KEYS, ["r", "g", "b"])
    vectors = embedding.embed_tiles(chips, embedding.BandHistogramEmbedder(3))
    points = tiles.join(vectors, tiling.TILE_KEYS).withColumn("cloud", F.lit(0.0)).withColumn("site", F.lit("aoi"))
    pairs = tile_pair_join(points, "2024-05-15", "2024-09-20", "Sentinel-2", ["embedding", "cloud", "date"])
    drift = {(r.tile_row, r.tile_col): r.drift for r in change_pair_score(pairs).collect()}
    assert len(drift) == 4
    stable = drift.pop((SIZE, SIZE))
    assert stable < 0.01
    assert min(drift.values()) > 10 * max(stable, 1e-3)


def test_tile_ids_bounds_and_ragged_edge(spark):
    scene = {1: planted_scenes(SIZE)[1][:, :50, :40]}
    tiles = tiling.ingest_tiles(pixel_table(spark, scene), scene_table(spark, (1,), 50, 40), BANDS, SIZE)
    row = tiles.collect()
    assert len(row) == 1
    assert row[0].tile_id == "s1_r0_c0_2024-05-15"
    assert list(row[0].bbox.bounds) == [274120.0, 2113150.0 - 320, 274120.0 + 320, 2113150.0]
    ring = row[0].bbox.coordinates[0]
    assert ring[0] == ring[-1] and len(ring) == 5


def test_quality_filters_count_bands_and_values(spark):
    # 25 % of pixels are zero in every band: both filters must drop the tile.
    bands = np.full((4, SIZE, SIZE), 100)
    bands[:, : SIZE // 4, :] = 0
    grid = tiling.tile_grid(pixel_table(spark, {1: bands}), scene_table(spark, (1,), SIZE, SIZE, nodata=0), BANDS, SIZE)
    row = grid.first()
    assert row.valid_ratio == 0.75 and row.dark_ratio == 0.25
    assert tiling.drop_nodata(grid).count() == 0 and tiling.drop_black(grid).count() == 0
    # One non-zero band keeps a pixel valid, while its dark values still count one by one.
    bands[3] = 100
    grid = tiling.tile_grid(pixel_table(spark, {1: bands}), scene_table(spark, (1,), SIZE, SIZE, nodata=0), BANDS, SIZE)
    row = grid.first()
    assert row.valid_ratio == 1.0 and row.dark_ratio == 0.25
    # Without a nodata value everything is valid.
    grid = tiling.tile_grid(pixel_table(spark, {1: bands}), scene_table(spark, (1,), SIZE, SIZE), BANDS, SIZE)
    assert grid.first().valid_ratio == 1.0


@pytest.mark.parametrize("overlap", [8, 1, 13])
def test_overlapping_windows_match_numpy(spark, overlap):
    scene = planted_scenes(SIZE)[1]
    grid = tiling.tile_grid(pixel_table(spark, {1: scene}), scene_table(spark, (1,)), BANDS, 20, overlap=overlap)
    got = {(r.tile_row, r.tile_col): r for r in tiling.drop_ragged(grid, 20).collect()}
    offsets = [o for o in range(0, 64, 20 - overlap) if o + 20 <= 64]
    assert sorted(got) == [(a, b) for a in offsets for b in offsets]
    for (a, b), row in got.items():
        grey = np.clip(scene[:3, a : a + 20, b : b + 20] / 255.0, 0, 1).mean(axis=0)
        assert row.n_pixels == 400
        assert abs(row.cloud_ratio - ((grey >= 0.82) | (grey <= 0.08)).mean()) < 1e-12


def test_unaligned_window_read(spark):
    scene = planted_scenes(SIZE)[1]
    asked = spark.createDataFrame([(1, 10, 25)], "scene_id int, tile_row int, tile_col int")
    rows = tiling.window_read(pixel_table(spark, {1: scene}), asked, SIZE).collect()
    got = np.full((SIZE, SIZE), -1)
    for r in rows:
        got[r.y - 10, r.x - 25] = r.r
    assert (got == scene[0, 10 : 10 + SIZE, 25 : 25 + SIZE]).all()


def reference_match(source, template):
    """Histogram matching by cumulative shares, in numpy."""
    values, where, counts = np.unique(source.ravel(), return_inverse=True, return_counts=True)
    t_values, t_counts = np.unique(template.ravel(), return_counts=True)
    share, t_share = np.cumsum(counts) / source.size, np.cumsum(t_counts) / template.size
    return np.interp(share, t_share, t_values)[where].reshape(source.shape)


def test_histogram_match_equals_numpy(spark):
    rng = np.random.default_rng(7)
    one, two = rng.integers(0, 60, (16, 16)) / 255.0, rng.integers(40, 200, (16, 16)) / 255.0
    rows = [("t", s, int(i), float(v)) for s, a in ((1, one), (2, two)) for i, v in enumerate(a.ravel())]
    pixels = spark.createDataFrame(rows, "tile string, side int, px int, level double")
    table = matching.match_table(pixels, ["tile"], "side", "level")
    matched = matching.apply_match(pixels.filter("side = 2"), table, ["tile"], "level").orderBy("px").collect()
    want = reference_match(two, one).ravel()
    assert np.abs(np.array([r.matched_value for r in matched]) - want).max() < 1e-12


def test_matching_removes_a_brightness_shift(spark):
    first = planted_scenes(SIZE)[1][:, :SIZE, :SIZE]
    shifted = np.clip(first * 0.6 + 20, 0, 255).astype(int)
    one = pixel_table(spark, {1: first}).withColumn("tile", F.lit(0))
    two = pixel_table(spark, {1: shifted}).withColumn("tile", F.lit(0))
    rows = matching.match_images(one, two, ["tile"], ["r", "g", "b", "nir"]).orderBy("y", "x").collect()
    for i, band in enumerate("rgb"):
        want = reference_match(shifted[i], first[i]).ravel()
        assert np.abs(np.array([r[band] for r in rows]) - want).max() < 1e-9
    model = embedding.BandHistogramEmbedder(3)
    vector = lambda px: np.array(embedding.embed_tiles(embedding.tile_chips(px, ["tile"], ["r", "g", "b"]), model).first().embedding)
    matched = np.array(embedding.embed_matched(one, two, ["tile"], ["r", "g", "b"], model).first().embedding)
    assert 1 - vector(one) @ matched < 0.2 * (1 - vector(one) @ vector(two))


def test_8bit_chips(spark):
    chips = spark.createDataFrame([(1, [0.0, 0.5, 1.0]), (2, [0.0, 127.0, 300.0])], "tile int, chip array<double>")
    got = {r.tile: list(r.chip) for r in embedding.to_8bit(chips).collect()}
    assert got == {1: [0.0, 127.0, 255.0], 2: [0.0, 127.0, 255.0]}


def test_pixel_difference_percentile_equals_numpy(spark):
    scenes = planted_scenes(SIZE)
    pixels = pixel_table(spark, scenes)
    diff = spectral.pixel_difference(
        pixels.filter("scene_id = 1"), pixels.filter("scene_id = 2"), ["y", "x"], ["r", "g", "b"]
    )
    row = spectral.difference_summary(diff.withColumn("tile", F.lit(0)), ["tile"]).first()
    want = np.abs(scenes[2][:3].astype(float) - scenes[1][:3]).mean(axis=0)
    assert abs(row.mean_diff - want.mean()) < 1e-9 and abs(row.max_diff - want.max()) < 1e-9
    assert abs(row.p98 - np.percentile(want, 98)) < 1e-9


def test_stretch_equals_numpy(spark):
    scene = planted_scenes(SIZE)[1] * 13
    pixels = pixel_table(spark, {1: scene}).withColumn("tile", F.lit(0))
    rows = spectral.percentile_stretch(pixels, ["tile"], ["r", "g", "b"]).orderBy("y", "x").collect()
    lo, hi = np.percentile(scene[:3], (2, 98))
    want = np.clip((scene[0] - lo) / (hi - lo) * 255.0, 0, 255).astype(np.uint8)
    assert [r.r for r in rows] == want.ravel().tolist()


def test_unit_scaling_leaves_unit_data_alone(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 1.0), (2, 127.5), (2, 300.0)], "tile int, v double")
    got = sorted((r.tile, r.v) for r in quality.to_unit(rows, ["tile"], ["v"]).collect())
    assert got == [(1, 0.5), (1, 1.0), (2, 0.5), (2, 1.0)]


def test_narrative_rounds_like_the_texts(spark):
    row = spark.createDataFrame([(0.0315, -0.25, 0.02)], "a double, b double, c double")
    told = row.select(
        spectral.change_text("infrastructure", F.col("a")),
        spectral.change_text("vegetation", F.col("b")),
        spectral.change_text("water", F.col("c")),
    ).first()
    assert told[0] == f"Built-up index increased slightly by {0.0315 * 100:.1f}% — minor surface alteration observed."
    assert told[1] == "Vegetation cover decreased by 25.0% — consistent with clearance or construction activity."
    assert told[2] == "Water index increased slightly by 2.0% — subtle seasonal moisture shift."


def test_models_are_given_few_inputs_at_once(spark):
    """Of one partition of 700 texts, some null, in order and each with its own vector."""
    texts = spark.range(700, numPartitions=1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("text"))

    def factory():
        return lambda inputs: np.array([[len(inputs), -1.0 if t is None else len(t)] for t in inputs])

    for r in embedding.embed_text(texts, factory).collect():
        length = r["id"] if r["id"] % 9 > 0 else -1
        given = 700 % 256 if r["id"] >= 512 else 256
        assert np.allclose(r["embedding"], np.array([given, length]) / np.hypot(given, length))
