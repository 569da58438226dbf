"""Packed blocks and the raster source against the long pixel table."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tilescope.operators import blocks, embedding, tiling
from tilescope.plans.raster_queries import windows_in
from tilescope.sources.raster_source import NpyStrips, RasterWindows, WindowReader

BANDS = ["r", "g", "b"]


@pytest.fixture(scope="module")
def pixels(spark):
    """Two scenes of 70 x 90 pixels with holes, and some pixels stored twice."""
    rng = np.random.default_rng(5)
    rows = [(s, y, x, *map(int, rng.integers(0, 256, 3))) for s in (1, 2) for y in range(70) for x in range(90) if rng.random() > 0.1]
    rows += [(s, y, x, 255, 0, 7) for s, y, x, *_ in rows[::97]]
    return spark.createDataFrame(rows, "scene_id int, y int, x int, r int, g int, b int").repartition(5).cache()


@pytest.fixture(scope="module")
def packed(spark, pixels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "b")
    blocks.write_blocks(blocks.pack_blocks(pixels, BANDS, 16), path, files=12)
    return spark.read.parquet(path)


def chips(df):
    return {(r["scene_id"], r["tile_row"], r["tile_col"]): list(r["chip"]) for r in df.collect()}


@pytest.mark.parametrize(("size", "overlap"), [(16, 0), (16, 8), (12, 5), (20, 0), (40, 10)])
def test_chips(pixels, packed, size, overlap):
    placed = tiling.place_in_windows(pixels, size, tiling.stride_of(size, overlap))
    want = chips(embedding.tile_chips(placed.filter("tile_row >= 0"), tiling.TILE_KEYS, BANDS))
    assert chips(blocks.chips_of_blocks(packed, BANDS, 16, size, overlap)) == want


def test_chips_of_blocks_do_not_move_pixels(packed):
    plan = blocks.chips_of_blocks(packed, BANDS, 16, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize(("size", "overlap"), [(16, 0), (16, 8)])
def test_batches_of_chips_are_bounded(packed, monkeypatch, size, overlap):
    """However many blocks a task is handed at once, it gives chips and pieces back a few at a time."""
    limit, caught = 20_000, []
    monkeypatch.setattr(blocks, "BATCH_BYTES", limit, raising=False)
    real = type(packed).mapInArrow
    monkeypatch.setattr(type(packed), "mapInArrow", lambda df, f, schema: caught.append(f) or real(df, f, schema))
    blocks.chips_of_blocks(packed, BANDS, 16, size, overlap)
    (given,) = packed.select(*blocks.BLOCK_KEYS, "seen", *BANDS).toArrow().combine_chunks().to_batches()
    back = list(caught[0](iter([given])))
    assert sum(b.num_rows for b in back) >= given.num_rows == 60
    assert max(b.nbytes for b in back) < 2 * limit


def test_window_reads_few_files_and_bands(packed):
    found = blocks.window_of_blocks(packed, 20, 33, ["g"], 16, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block_row), IsNotNull(block_col), GreaterThanOrEqual(block_row,1)" in plan
    assert "ReadSchema: struct<scene_id:int,block_row:bigint,block_col:bigint,seen:binary,g:binary>" in plan


def test_files_hold_neighbours(spark, tmp_path):
    """32 x 32 blocks in 32 files: a window's blocks are in few of them, whichever way it lies."""
    grid = spark.range(1024).select(F.lit(1).alias("scene_id"), F.expr("id div 32").alias("block_row"), (F.col("id") % 32).alias("block_col"))
    grid = grid.withColumn("z", blocks.z_value(F.col("block_row"), F.col("block_col")))
    blocks.write_blocks(grid, str(tmp_path / "g"), files=32)
    back = spark.read.parquet(str(tmp_path / "g"))
    spans = back.groupBy(F.input_file_name()).agg(F.min("block_row"), F.max("block_row"), F.min("block_col"), F.max("block_col")).collect()
    assert len(spans) > 24

    def met(rows, cols):
        return sum(s[1] <= rows[1] and s[2] >= rows[0] and s[3] <= cols[1] and s[4] >= cols[0] for s in spans)

    met_by = [met((r, r + 1), (c, c + 1)) for r in range(31) for c in range(31)]
    assert np.mean(met_by) < 4 and np.median(met_by) <= 4 and max(met_by) < len(spans) / 2


def test_window_equals_the_pixels(pixels, packed):
    single = pixels.groupBy("scene_id", "y", "x").agg(*[F.max(c).alias(c) for c in BANDS])
    want = single.filter("y between 20 and 42 and x between 5 and 27")
    got = blocks.window_of_blocks(packed, 20, 5, BANDS, 16, 23)
    assert sorted(tuple(map(int, r)) for r in got.collect()) == sorted(map(tuple, want.collect()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(6)
    path = str(tmp_path_factory.mktemp("rasters"))
    for scene in (1, 2, 3):
        values = rng.integers(0, 256, (3, 70, 90)).astype("float64")
        values[0, 5, 5] = np.nan
        for top in (0, 48):
            NpyStrips.write(path, scene, f"2024-0{scene}-01", top, BANDS, values[:, top : top + 48])
    return path


def partitions(spark, folder, where):
    return windows_in(spark, folder, 16).filter(where).rdd.getNumPartitions()


def test_one_window_opens_one_partition(spark, folder):
    assert windows_in(spark, folder, 16).rdd.getNumPartitions() == 3 * 5 * 6
    assert partitions(spark, folder, "scene_id = 2 and block_row = 1 and block_col = 3") == 1
    assert partitions(spark, folder, "date >= '2024-03-01'") == 30
    assert partitions(spark, folder, "date in ('2024-01-01', '2024-02-01') and block_row between 1 and 2 and block_col < 2") == 8
    (row,) = windows_in(spark, folder, 16).filter("scene_id = 2 and block_row = 4 and block_col = 5").collect()
    seen = np.frombuffer(row["seen"], "uint8").reshape(16, 16)
    assert seen[:6, :10].all() and seen.sum() == 60


def test_source_gives_the_files_pixels(spark, folder):
    got = blocks.window_of_blocks(windows_in(spark, folder, 16).filter("scene_id = 3"), 0, 0, BANDS, 16, 100).collect()
    strips = NpyStrips()
    files = [f for f in strips.scenes(folder) if f["scene_id"] == 3]
    want = np.concatenate([strips.read(f, 0, 0, f["height"], 90) for f in sorted(files, key=lambda f: f["top"])], axis=1)
    assert len(got) == 70 * 90 - 1
    assert all((r["r"], r["g"], r["b"]) == tuple(want[:, r["y"], r["x"]]) for r in got)


def test_more_windows_than_partitions(folder, monkeypatch):
    monkeypatch.setattr("tilescope.sources.raster_source.MOST_PARTITIONS", 7)
    files = NpyStrips().scenes(folder)
    reader = WindowReader(files, NpyStrips(), 16, BANDS)
    parts = reader.partitions()
    assert len(parts) <= 7 and sum(len(p.windows) for p in parts) == 90
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 90
    assert RasterWindows({"folder": folder, "decoder": "tilescope.sources.raster_source:NpyStrips", "size": "16"}).schema().endswith("`b` binary")


def test_many_small_windows_share_partitions_and_tasks_get_no_file_list(folder):
    files = [f | {"top": 64 * k, "path": f"{k}_{f['path']}"} for k in range(200) for f in NpyStrips().scenes(folder)]
    reader = WindowReader(files, NpyStrips(), 16, BANDS)
    parts = reader.partitions()
    windows = sum(-(-f["height"] // 16) * -(-f["width"] // 16) for f in files)
    assert len(parts) <= 256 < windows == sum(len(p.windows) for p in parts)
    few = WindowReader(files[:2], NpyStrips(), 16, BANDS)
    assert len(cloudpickle.dumps(reader)) == len(cloudpickle.dumps(few))
