"""A stored index over vectors for exact search by cosine that leaves most files unread.

Vectors count as points of the unit sphere. Each belongs to its nearest centre, and the rows of a centre's
cell are cut into slices by their distance to it; a slice is a folder of Parquet files sorted by that distance.
For a query at distance D from a centre, a row at distance r from it is at least |D - r| away (triangle
inequality). So a slice with distances from `least` to `most` holds nothing nearer than
max(0, D - most, least - D). A search reads the most promising slices until it has top_k hits, and then all
slices whose bound does not exceed the distance of the last hit. Results equal those of a full scan; how many
slices that spares depends on how clustered the vectors are.

Centres are fitted on a bounded sample, every row is indexed. Centres, and the table of slices, are limited by
MOST_CELLS and MOST_SLICES whatever the number of rows, so the driver may hold them; rows per slice grow
instead. Rows without a vector, and zero vectors (cosine 0 with everything), have a cell of their own.

An upsert writes the touched slices anew beside the old ones and commits a table of slices that names both new
and untouched folders; readers of the version before are not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions import vectors
from tilescope.functions.ranking import top_per_key
from tilescope.operators import search
from tilescope.sources.stores import VersionedTable

SAMPLE_ROWS = 16_384  # rows that centres are fitted on: those with the smallest hashes of their ids
MOST_CELLS = 1024
BINS = 256  # steps of distance (0 to 2) at which a cell can be cut
SLICE_ROWS = 16_384
MOST_SLICES = 32_768  # beside one per cell; larger tables get larger slices
ROUNDS = 12
PLACED_AT_ONCE = 512  # rows whose cosines with all centres a task holds
MARGIN = 1e-6  # more than rounding can shift a distance
OWN = ["_cell", "_r", "_bin", "_slice"]


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1)[:, None]


def fitted_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres: rows far from those before as a start, then a few rounds of means."""
    rows = _unit(sample[np.linalg.norm(sample, axis=1) > config.ZERO_NORM])
    if not len(rows):
        return np.zeros((0, sample.shape[1]))
    picked = [0]
    nearest = rows @ rows[0]
    while len(picked) < min(cells, len(rows)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[picked[-1]])
    centres = rows[picked]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > config.ZERO_NORM, sums / np.maximum(length, config.ZERO_NORM)[:, None], centres)
    return centres


class MetricIndex:
    """Rows with a vector, kept in slices under one folder."""

    def __init__(self, spark: SparkSession, folder: str, vector: str = "embedding", key: str = "point_id"):
        self.spark, self.folder, self.vector, self.key = spark, folder.rstrip("/"), vector, key
        self.centre_table = VersionedTable(spark, f"{self.folder}/centres")
        self.slice_table = VersionedTable(spark, f"{self.folder}/slices")

    # -- layout ----------------------------------------------------------------

    def centres(self) -> np.ndarray:
        rows = self.centre_table.read().orderBy("cell").collect()
        return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))

    def slices(self) -> pd.DataFrame:
        """The current table of slices: slice, cell, low and high bin, rows, least, most, path, files."""
        return self.slice_table.read().toPandas().sort_values("slice", ignore_index=True)

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """Rows with their cell, distance to its centre, and bin; odd vectors are in the cell behind the last."""

        def at(matrix: np.ndarray) -> np.ndarray:
            odd = ~(np.linalg.norm(matrix, axis=1) > config.ZERO_NORM)
            cosine = np.where(odd[:, None], -1.0, _unit(matrix) @ centres.T)
            cell = np.where(odd, len(centres), cosine.argmax(axis=1))
            return np.stack([cell, np.where(odd, 0.0, np.sqrt(np.maximum(0.0, 2 - 2 * cosine.max(axis=1))))], 1)

        @F.arrow_udf("array<double>")
        def place(batch: pa.Array) -> pa.Array:
            if not len(centres):
                return pa.array([[0.0, 0.0]] * len(batch), pa.list_(pa.float64()))
            parts = [batch.slice(first, PLACED_AT_ONCE) for first in range(0, len(batch), PLACED_AT_ONCE)]
            found = np.concatenate([np.zeros((0, 2)), *(at(vectors.batch_matrix(p, centres.shape[1])) for p in parts)])
            offsets = np.arange(0, found.size + 1, 2, dtype="int32")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

        # Not to be pushed into the filters of joins on the cell, where Spark would place every row once more.
        place = place.asNondeterministic()
        placed = rows.withColumn("_at", place(F.col(self.vector)))
        placed = placed.withColumns({"_cell": F.col("_at")[0].cast("int"), "_r": F.col("_at")[1]}).drop("_at")
        return placed.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(F.col("_r") * (BINS / 2))).cast("int"))

    def _bins(self, table: pd.DataFrame) -> DataFrame:
        """(_cell, _bin, _slice, _files) of every bin of every cell: at most (MOST_CELLS + 1) * BINS rows."""
        rows = []
        for cell, own in table.groupby("cell"):
            own = own.sort_values("low")
            at = np.maximum(np.searchsorted(own["low"].to_numpy(), np.arange(BINS), "right") - 1, 0)
            rows.append(
                pd.DataFrame(
                    {"_cell": np.int32(cell), "_bin": np.arange(BINS, dtype="int32"), "_slice": own["slice"].to_numpy()[at], "_files": own["files"].to_numpy()[at]}
                )
            )
        return self.spark.createDataFrame(pd.concat(rows), "_cell int, _bin int, _slice int, _files int")

    def _write(self, placed: DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """Write rows with their slices; the table with what the written slices now hold."""
        path = f"data/{uuid.uuid4().hex}"
        rows = placed.drop("_slice").join(F.broadcast(self._bins(table)), ["_cell", "_bin"])
        # A slice that ties made large goes to several tasks.
        part = F.pmod(F.xxhash64(self.key), F.greatest(F.lit(1), F.col("_files"))).alias("_part")
        rows = rows.withColumn("_part", part).repartition("_slice", "_part").drop("_part", "_files")
        rows.sortWithinPartitions("_slice", "_r").write.partitionBy("_slice").parquet(f"{self.folder}/{path}")
        back = self.spark.read.parquet(f"{self.folder}/{path}")
        held = back.groupBy("_slice").agg(F.count("*").alias("n"), F.min("_r").alias("a"), F.max("_r").alias("b")).toPandas()
        held = held.set_index("_slice")
        table = table.copy()
        there = table["slice"].isin(held.index)
        for column, source in (("rows", "n"), ("least", "a"), ("most", "b")):
            table.loc[there, column] = held.loc[table.loc[there, "slice"], source].to_numpy()
        table.loc[there, "path"] = [f"{path}/_slice={k}" for k in table.loc[there, "slice"]]
        return table

    def _commit(self, table: pd.DataFrame) -> None:
        kinds = "slice int, cell int, low int, rows long, least double, most double, path string, files int"
        rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in table[[c.split()[0] for c in kinds.split(", ")]].astype(object).values.tolist()]
        rows = [(int(a), int(b), int(c), int(d), *rest[:-1], int(rest[-1])) for a, b, c, d, *rest in rows]
        self.slice_table.write(self.spark.createDataFrame(rows, kinds).coalesce(1))

    # -- writing ---------------------------------------------------------------

    def build(self, rows: DataFrame, slice_rows: int = SLICE_ROWS) -> "MetricIndex":
        """Index every row of a table for the first time."""
        n = rows.count()
        slice_rows = max(slice_rows, -(-n // MOST_SLICES))
        cells = int(min(MOST_CELLS, max(1, -(-n // slice_rows) // 2, int(np.sqrt(n) / 4))))
        known = rows.filter(F.col(self.vector).isNotNull()).select(self.key, F.col(self.vector).cast("array<double>").alias("v"))
        sample = known.orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
        centres = fitted_centres(np.array(sample.tolist()), cells) if len(sample) else np.zeros((0, 0))
        kinds = "cell int, centre array<double>"
        self.centre_table.write(self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], kinds).coalesce(1))
        placed = self._placed(rows, centres)
        counts = placed.groupBy("_cell", "_bin").count().toPandas().sort_values(["_cell", "_bin"])
        table = []
        for cell in range(len(centres) + 1):
            own = counts[counts["_cell"] == cell]
            size = own["count"].to_numpy()
            part = (np.cumsum(size) - size) // slice_rows if len(own) else np.zeros(0, int)
            lows = own["_bin"].to_numpy()[np.r_[True, part[1:] != part[:-1]]] if len(own) else np.array([0])
            held = np.bincount(np.unique(part, return_inverse=True)[1], size) if len(own) else np.array([0])
            for low, m in zip(lows.tolist(), held.tolist(), strict=True):
                table.append((len(table), cell, low, 0, np.nan, np.nan, None, max(1, -(-int(m) // (2 * slice_rows)))))
        table = pd.DataFrame(table, columns=["slice", "cell", "low", "rows", "least", "most", "path", "files"])
        self._commit(self._write(placed, table) if n else table)
        return self

    def upsert(self, feed: DataFrame, version: str = "version") -> None:
        """Insert or replace rows by key; the highest version wins. Only slices that lose or gain rows are written."""
        table = self.slices()
        feed = top_per_key(feed, [self.key], [F.col(version).desc()])
        placed = self._placed(feed, self.centres()).join(F.broadcast(self._bins(table).drop("_files")), ["_cell", "_bin"])
        if not table["rows"].sum():
            self._commit(self._write(placed, table))
            return
        gone = self._read(table).join(feed.select(self.key), self.key, "left_semi").select("_slice")
        touched = [r[0] for r in gone.union(placed.select("_slice")).distinct().collect()]
        if not touched:
            return
        hit = table["slice"].isin(touched)
        both = self._read(table[hit]).unionByName(placed, allowMissingColumns=True)
        rows = top_per_key(both, [self.key], [F.col(version).desc()])
        table.loc[hit, "rows"] = 0
        table.loc[hit, ["least", "most"]] = np.nan
        table.loc[hit, "path"] = None
        self._commit(self._write(rows, table))

    # -- reading ---------------------------------------------------------------

    def _read(self, table: pd.DataFrame) -> DataFrame:
        """The rows of some slices, with their place in the index."""
        known = self.slices()["path"].dropna()
        if known.empty:
            raise LookupError(f"nothing is indexed under {self.folder}")
        base, _, _ = known.iloc[0].rpartition("/")
        schema = self.spark.read.option("basePath", f"{self.folder}/{base}").parquet(f"{self.folder}/{known.iloc[0]}").schema
        paths = [f"{self.folder}/{p}" for p in table["path"].dropna()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Slices lie in folders of the writes that made them.
        reader = self.spark.read.schema(schema)
        by_write: dict[str, list[str]] = {}
        for p in paths:
            by_write.setdefault(p.rsplit("/", 1)[0], []).append(p)
        parts = [reader.option("basePath", base).parquet(*own) for base, own in by_write.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def rows(self) -> DataFrame:
        """All rows as they were given."""
        return self._read(self.slices()).drop(*OWN)

    def bounds(self, query: Sequence[float]) -> pd.DataFrame:
        """The slices that hold rows with the smallest distance any of their rows can have, nearest first."""
        table, centres = self.slices(), self.centres()
        table = table[table["rows"] > 0].copy()
        unit = np.asarray(query, "float64")
        length = np.linalg.norm(unit)
        if length <= config.ZERO_NORM or not len(centres):
            return table.assign(bound=0.0)
        away = np.r_[np.sqrt(np.maximum(0.0, 2 - 2 * centres @ (unit / length))), 0.0][table["cell"]]
        bound = np.maximum(0.0, np.maximum(away - table["most"], table["least"] - away))
        # Vectors without a direction score 0, as far as at a right angle.
        table["bound"] = np.where(table["cell"] == len(centres), np.sqrt(2.0), bound)
        return table.sort_values(["bound", "slice"], ignore_index=True)

    def search(
        self,
        query: Sequence[float],
        top_k: int = config.SEARCH_TOP_K,
        date: str | None = None,
        sensor: str | None = None,
        where: Column | None = None,
        tie: Sequence[str] = ("tile_id",),
    ) -> DataFrame:
        """The same rows as knn_search over all rows, from the slices that can hold them."""

        def hits(table: pd.DataFrame) -> DataFrame:
            rows = self._read(table).drop(*OWN)
            rows = rows if where is None else rows.filter(where)
            return search.knn_search(rows, query, top_k, date, sensor, vector=self.vector, tie=tie)

        table = self.bounds(query)
        want, probed = 4 * top_k, 0
        while probed < len(table):
            probed = int(np.searchsorted(np.cumsum(table["rows"]), want)) + 1
            found = hits(table.iloc[:probed]).agg(F.count("score"), F.min("score")).first()
            if found[0] >= top_k:
                least = found[1] - 10.0**-vectors.SCORE_DIGITS
                reach = np.sqrt(max(0.0, 2 - 2 * least)) + MARGIN
                return hits(table[table["bound"] <= reach])
            want *= 4
        return hits(table)

    def similar(self, request_id: str, top_k: int = 6, exclude_self: bool = True) -> DataFrame:
        """The same rows as similar_tile over all rows."""
        aliases, vector = search.stored_vector(self.rows(), request_id, self.vector)
        where = F.coalesce(F.col("tile_id"), F.lit("")) != ""
        if exclude_self:
            where &= ~F.col("tile_id").isin(aliases)
        return self.search(vector, top_k, where=where)
