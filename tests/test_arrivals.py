"""Histories kept while scenes arrive: any order gives what the batch plan gives."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_core import RULES, tile, tile_table
from tilescope.operators import change
from tilescope.streaming.arrivals import TABLE, history_store, keep_history

DAYS = ["2024-01-01", "2024-03-01", "2024-06-01", "2024-09-01", "2024-12-01"]


def scenes():
    """Rows of five dates and three cells: clouds, copies with smaller ids, a cell with one date, vectors that turn."""
    turned = random.Random(4)
    rows = []
    for k, day in enumerate(DAYS):
        angle = [(1, 0), (0.9, 0.4), (0, 1), (-0.5, 0.8), (1, 0)][k]
        rows.append(tile(day, vec=angle, cloud=0.9 if k == 2 else 0.0))
        rows.append(tile(day, row=256, vec=(turned.random(), turned.random())))
        rows.append(tile(day, row=256, vec=(turned.random(), turned.random()), point="a"))
    return rows + [tile(DAYS[3], col=256)]


def shown(rows):
    return sorted(
        (r.tile_row, r.tile_col, r.n_dates, r.earliest_change, r.t1_tile_id, r.t2_tile_id, round(r.drift, 9), round(r.raw_drift, 9), r.suppressed, str(r.intervals))
        for r in rows.collect()
    )


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_any_order_gives_the_batch_history(spark, tmp_path, order):
    rows = scenes()
    want = shown(change.cell_history(tile_table(spark, rows), DAYS, None, RULES))
    parts = {"forward": [0, 1, 2, 3, 4], "backward": [4, 3, 2, 1, 0], "mixed": [2, 0, 4, 1, 3]}[order]
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    (tmp_path / "in").mkdir()
    store = history_store(spark, str(tmp_path / "store"), buckets=4)
    extra = tile_table(spark, rows).withColumn("seen", F.lit("clash")).withColumn("cell", F.lit(1))
    stream = spark.readStream.schema(extra.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def arrive(part):
        some = extra.filter(F.col("date") == DAYS[part])
        some.coalesce(1).write.mode("append").parquet(source)

    for part in parts[:2]:
        arrive(part)
    keep_history(stream, store, marks, RULES).awaitTermination()
    assert len(store.versions()) == 2, "one commit per batch"
    two = sorted(DAYS[k] for k in parts[:2])
    some = tile_table(spark, [r for r in rows if r[3] in two])
    assert shown(store.read(TABLE)) == shown(change.cell_history(some, two, None, RULES))
    for part in parts[2:]:  # the stream goes on where it was
        arrive(part)
    keep_history(stream, store, marks, RULES).awaitTermination()
    assert shown(store.read(TABLE)) == want


def test_copies_and_rows_without_a_place_change_nothing(spark, tmp_path):
    rows = [tile(DAYS[0]), tile(DAYS[1], vec=(0, 1))]
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    (tmp_path / "in").mkdir()
    store = history_store(spark, str(tmp_path / "store"), buckets=4)
    table = tile_table(spark, rows)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table.coalesce(1).write.mode("append").parquet(source)
    keep_history(stream, store, marks, RULES).awaitTermination()
    before = shown(store.read(TABLE))
    assert [r[3] for r in before] == [DAYS[1]]
    files = store.state()["tables"][TABLE]["files"]
    again = table.unionByName(table.withColumn("site", F.lit(None).cast("string"))).unionByName(table.withColumn("date", F.lit(None).cast("string")))
    again.coalesce(1).write.mode("append").parquet(source)
    keep_history(stream, store, marks, RULES).awaitTermination()
    assert shown(store.read(TABLE)) == before
    assert store.state()["tables"][TABLE]["files"] == files, "a batch that changes no cell writes no bucket"
