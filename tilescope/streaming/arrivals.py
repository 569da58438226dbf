"""Change histories kept up to date while scenes arrive, in any order.

The tiles of a cell are the state of its key: one entry per date, the smallest point id of the date, as the
batch plan keeps it. A tile that arrives late takes its place between two dates and so splits their interval;
a smaller point id of a known date takes the place of the tile that stood there. Whenever a batch changes a
cell, the cell's tiles leave the state in date order, and the batch's own scoring (change.history_of_seen)
turns them into intervals, the span and the earliest date. A row that changes nothing emits nothing.

Histories go to a bucketed store by cell, so a batch writes the buckets of the cells it changed and a batch
that runs again after its commit changes nothing. After all rows have come, the store holds what the batch
plan gives for the same tiles and dates, whatever the order of arrival. The state of a cell is bounded by the
number of dates, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tilescope import config
from tilescope.config import ChangeRules
from tilescope.operators import change
from tilescope.sources.bucket_store import BucketStore
from tilescope.streaming.feeds import stream_id

TABLE = "history"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TILE = "point_id string, tile_id string, embedding array<double>, cloud double, date string"
SEEN = f"site string, tile_row long, tile_col long, seen array<struct<{TILE.replace(' ', ':').replace(',:', ',')}>>"
_FIELDS = ["point_id", "tile_id", "embedding", "cloud"]


class CellTiles(StatefulProcessor):
    """The tiles of one cell by date."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tiles = handle.getMapState("tiles", "date string", "point_id string, tile_id string, embedding array<double>, cloud double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for frame in rows:
            for point, tile, vector, cloud, date in zip(*(frame[c] for c in [*_FIELDS, "date"]), strict=True):
                if date not in best or point < best[date][0]:
                    vector = None if vector is None else [float(x) for x in vector]
                    best[date] = (point, tile, vector, None if pd.isna(cloud) else float(cloud))
        changed = False
        for date, tile in best.items():
            known = self.tiles.getValue((date,)) if self.tiles.containsKey((date,)) else None
            if known is None or tile[0] < known[0]:
                self.tiles.updateValue((date,), tile)
                changed = True
        if changed:
            seen = sorted(((date[0], tuple(tile)) for date, tile in self.tiles.iterator()), key=lambda entry: entry[0])
            listed = [dict(zip(_FIELDS, tile, strict=True)) | {"date": date} for date, tile in seen]
            yield pd.DataFrame({"site": [key[0]], "tile_row": [key[1]], "tile_col": [key[2]], "seen": [listed]})

    def close(self) -> None:
        pass


def changed_cells(tiles: DataFrame) -> DataFrame:
    """(cell, seen) of every cell that a batch of a stream of tiles changes.

    Rows without a place, a date or a point id are no tile of a cell and are left out. Columns beyond the named
    ones are not read.
    """
    whole = tiles.select(
        "site", *(F.col(c).cast("long").alias(c) for c in ("tile_row", "tile_col")), "point_id", "tile_id",
        F.col("embedding").cast("array<double>").alias("embedding"), F.col("cloud").cast("double").alias("cloud"), "date",
    ).dropna(subset=[*change.CELL, "date", "point_id"])
    return whole.groupBy(*change.CELL).transformWithStateInPandas(CellTiles(), SEEN, "Update", "None")


def history_store(spark: SparkSession, folder: str, buckets: int = 16) -> BucketStore:
    """A store of histories by cell."""
    return BucketStore(spark, folder, {TABLE: "cell"}, buckets)


def keep_history(
    tiles: DataFrame,
    store: BucketStore,
    checkpoint: str,
    rules: ChangeRules = ChangeRules(),
    max_ratio: float = config.CLOUD_SHADOW_MAX_RATIO,
) -> StreamingQuery:
    """Follow a stream of tiles until it has nothing new; the store's `history` then has every cell.

    State lives in RocksDB next to the checkpoint, so it may outgrow a worker's memory.
    """
    spark = tiles.sparkSession
    before = spark.conf.get(STATE_STORE)

    def apply(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        with store.transaction() as t:
            if t.seen(stream, number):
                return
            cells = batch.persist()  # the state is updated once per batch, so it is read once
            try:
                found = change.history_of_seen(cells, rules, max_ratio)
                t.upsert(TABLE, found.withColumn("cell", F.to_json(F.struct(*change.CELL))))
            finally:
                cells.unpersist()

    spark.conf.set(STATE_STORE, ROCKS)
    try:  # a query keeps the settings it was started with
        return (
            changed_cells(tiles)
            .writeStream.foreachBatch(apply)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
