"""Raster files as a Spark data source: partitions of windows, and filters that decide which windows open.

    spark.dataSource.register(RasterWindows)
    spark.read.format("raster_windows").option("folder", ...).option("decoder", "package.module:Decoder").option("size", 256).load()

gives the packed blocks of tilescope.operators.blocks, with the date of the scene. A decoder is a class made
without arguments. `scenes(folder)` lists the files as dicts with scene_id, date, path, top (the file's first
row in the scene), height, width and bands; `read(file, y, x, height, width)` returns one array per band for a
window of the file, missing pixels as NaN. It runs where the partition does, so a file is opened there and
only the window is read.

Filters on scene_id, date, block_row and block_col choose the partitions. More windows than FEW_PARTITIONS are
dealt to partitions in stretches, so that starting tasks does not outweigh reading; a stretch holds about
PARTITION_PIXELS, unless that would make more than MOST_PARTITIONS. Each still reads window by window.
"""

from __future__ import annotations

import glob
import importlib
import json
import os
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

FEW_PARTITIONS = 256
PARTITION_PIXELS = 1 << 22
MOST_PARTITIONS = 50_000
_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


class NpyStrips:
    """Scenes as NumPy files of whole rows: a strip's values in bands x rows x columns, its place in a JSON file beside it."""

    def scenes(self, folder: str) -> list[dict]:
        found = []
        for name in sorted(glob.glob(f"{folder}/*.json")):
            with open(name) as f:
                found.append(json.load(f) | {"path": name[:-5] + ".npy"})
        return found

    def read(self, file: dict, y: int, x: int, height: int, width: int) -> Sequence[np.ndarray]:
        return np.load(file["path"], mmap_mode="r")[:, y : y + height, x : x + width].astype("float64")

    @staticmethod
    def write(folder: str, scene_id: int, date: str, top: int, bands: Sequence[str], values: np.ndarray) -> None:
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/scene{scene_id}_{top}"
        np.save(name + ".npy", values)
        place = {"scene_id": scene_id, "date": date, "top": top, "height": values.shape[1], "width": values.shape[2], "bands": list(bands)}
        with open(name + ".json", "w") as f:
            json.dump(place, f)


class Windows(InputPartition):
    def __init__(self, windows: list[tuple[dict, int, int]]):
        self.windows = windows  # (file, block row, block column)


class RasterWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_windows"

    def _decoder(self) -> Any:
        module, _, name = self.options["decoder"].partition(":")
        return getattr(importlib.import_module(module), name)()

    def _files(self) -> list[dict]:
        return self._decoder().scenes(self.options["folder"])

    def schema(self) -> str:
        bands = dict.fromkeys(b for f in self._files() for b in f["bands"])
        return "scene_id long, date string, block_row long, block_col long, z long, seen binary, " + ", ".join(f"`{b}` binary" for b in bands)

    def reader(self, schema: StructType) -> "WindowReader":
        return WindowReader(self._files(), self._decoder(), int(self.options["size"]), [f.name for f in schema][6:])


class WindowReader(DataSourceReader):
    def __init__(self, files: list[dict], decoder: Any, size: int, bands: list[str]):
        self.files, self.decoder, self.size, self.bands = files, decoder, size, bands
        self.tests: list[tuple[str, Any, Any]] = []

    def __getstate__(self) -> dict:
        """What a task reads with: its partition names its files, so the list of all of them stays behind."""
        return self.__dict__ | {"files": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("scene_id",), ("date",), ("block_row",), ("block_col",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _wanted(self, **values: Any) -> bool:
        return all(name not in values or _TESTS[test](values[name], value) for name, test, value in self.tests)

    def partitions(self) -> list[Windows]:
        size, found = self.size, []
        for f in self.files:
            if f["top"] % size:
                raise ValueError(f"{f['path']} does not begin at a block")
            if not self._wanted(scene_id=f["scene_id"], date=f["date"]):
                continue
            rows = range(f["top"] // size, -(-(f["top"] + f["height"]) // size))
            for r in (r for r in rows if self._wanted(block_row=r)):
                found += [(f, r, c) for c in range(-(-f["width"] // size)) if self._wanted(block_col=c)]
        wanted = min(MOST_PARTITIONS, max(FEW_PARTITIONS, -(-len(found) * size * size // PARTITION_PIXELS)))
        each = max(1, -(-len(found) // wanted))
        return [Windows(found[k : k + each]) for k in range(0, len(found), each)]

    def read(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        size = self.size
        for f, row, col in partition.windows if partition is not None else []:
            got = dict(zip(f["bands"], self.decoder.read(f, row * size - f["top"], col * size, size, size), strict=True))
            shape = next(iter(got.values())).shape
            seen = np.zeros((size, size), "uint8")
            seen[: shape[0], : shape[1]] = ~np.any([np.isnan(v) for v in got.values()], axis=0)
            if not seen.any():
                continue
            packed = []
            for b in self.bands:
                values = np.zeros((size, size))
                if b in got:
                    values[: shape[0], : shape[1]] = np.nan_to_num(got[b])
                packed.append(values.tobytes())
            z = sum(((row >> k & 1) << 2 * k + 1) | ((col >> k & 1) << 2 * k) for k in range(24))
            columns = [[f["scene_id"]], [f["date"]], [row], [col], [z], [seen.tobytes()], *([p] for p in packed)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * (1 + len(packed))]
            names = ["scene_id", "date", "block_row", "block_col", "z", "seen", *self.bands]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
