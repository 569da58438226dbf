"""Packed pixel blocks: a raster as squares of pixels, one binary column per band, ordered along a Z curve.

A block is a row (scene_id, block_row, block_col, z, seen, one column per band). Bands hold the block's values
row by row as little-endian doubles; `seen` has a byte per pixel, 0 where the raster has none. Files are sorted
by scene and Z value, so a window's blocks lie in few of them and the minima and maxima that Parquet keeps for
block_row, block_col and z let a scan pass over the others. Pixels are packed once; after that a query moves
blocks, or what is computed from a block inside a task, never single pixels.

Copies of a pixel count once; of unequal ones the largest bands stand, one by one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.operators import tiling

BLOCK_KEYS = ["scene_id", "block_row", "block_col"]
Z_BITS = 24
PACKED = 128  # pixels along the side of a square that is packed at once, where blocks are smaller
BATCH_BYTES = 4_000_000  # of chips or pieces in one batch that a task gives back, however many blocks it was handed at once


def z_value(row: Column, col: Column) -> Column:
    """Bits of two block numbers, taken in turns."""
    out = F.lit(0).cast("long")
    for bit in range(Z_BITS):
        for shift, value in ((2 * bit + 1, row), (2 * bit, col)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), shift))
    return out


def pack_blocks(pixels: DataFrame, bands: Sequence[str], size: int) -> DataFrame:
    """Blocks of size x size pixels of pixels(scene_id, y, x, bands): the one shuffle of pixels."""
    kind = pixels.schema["scene_id"].dataType.simpleString()
    schema = f"scene_id {kind}, block_row long, block_col long, seen binary, " + ", ".join(f"`{b}` binary" for b in bands)

    per = max(1, PACKED // size)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy("int64"), rows["x"].to_numpy("int64")
        row, col = y // size, x // size
        # The square's blocks that hold pixels, and each pixel's place in them laid end to end.
        spots, block = np.unique((row - key[1] * per) * per + col - key[2] * per, return_inverse=True)
        at = (block * size + y - row * size) * size + x - col * size
        seen = np.zeros(len(spots) * size * size, "uint8")
        seen[at] = 1

        def bytes_of(values: np.ndarray) -> list[bytes]:
            return [part.tobytes() for part in values.reshape(len(spots), -1)]

        out = {"scene_id": [key[0]] * len(spots), "block_row": key[1] * per + spots // per, "block_col": key[2] * per + spots % per, "seen": bytes_of(seen)}
        for b in bands:
            values = np.full(len(seen), -np.inf)
            np.maximum.at(values, at, rows[b].to_numpy("float64"))
            out[b] = bytes_of(np.where(seen > 0, values, 0.0))
        return pd.DataFrame(out)

    square = [F.floor(F.col(c) / (size * per)).cast("long").alias(f"__{c}") for c in ("y", "x")]
    packed = pixels.select("scene_id", "y", "x", *bands, *square).groupBy("scene_id", "__y", "__x").applyInPandas(pack, schema)
    return packed.withColumn("z", z_value(F.col("block_row"), F.col("block_col")))


def write_blocks(blocks: DataFrame, path: str, files: int | None = None) -> None:
    """Blocks as Parquet files, each a stretch of the Z curve of a scene."""
    order = ["scene_id", "z"]
    dealt = blocks.repartitionByRange(files, *order) if files else blocks.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(path)


def _opened(batch: pa.RecordBatch, bands: Sequence[str], size: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """(row, seen, values by band) of every block of a batch, as views on its bytes."""
    columns = {c: batch.column(c) for c in ("seen", *bands)}
    for k in range(batch.num_rows):
        seen = np.frombuffer(columns["seen"][k].as_buffer(), "uint8").reshape(size, size) > 0
        yield k, seen, {b: np.frombuffer(columns[b][k].as_buffer(), "<f8").reshape(size, size) for b in bands}


def grid_of_blocks(
    blocks: DataFrame,
    scenes: DataFrame,
    bands: Sequence[str],
    block: int,
    size: int = config.TILE_SIZE,
    overlap: int = 0,
    black: float = config.BLACK_PIXEL_THRESHOLD,
    rules: config.QualityRules = config.QualityRules(),
    full_scale: float = 255.0,
) -> DataFrame:
    """The rows of tiling.tile_grid, counted inside blocks; only totals of cells are shuffled, for overlapping windows.

    Cells are the largest squares that windows and blocks are whole numbers of.
    """
    stride = tiling.stride_of(size, overlap)
    cell = math.gcd(math.gcd(size, stride), block)
    facts = scenes.select("scene_id", F.col("nodata").cast("double").alias("nodata"), "width", "height")
    joined = blocks.select(*BLOCK_KEYS, "seen", *bands).join(F.broadcast(facts) if facts.count() <= 10_000 else facts, "scene_id")
    colour = list(bands[:3])
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    names = ["n_pixels", "n_valid", "dark_raw", "dark_scaled", "murky_raw", "murky_scaled"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("scene_id", "width", "height")) + ", by long, bx long, max_value double, "
    schema += ", ".join(f"{c} long" for c in names)
    per = block // cell

    def cells(values: np.ndarray) -> np.ndarray:
        """(cells, pixels) of a block."""
        return values.reshape(per, cell, per, cell).swapaxes(1, 2).reshape(per * per, cell * cell)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(c).to_pylist() for c in ("scene_id", "block_row", "block_col", "nodata", "width", "height")}
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for k, seen, values in _opened(batch, bands, block):
                there = cells(seen)
                nodata = given["nodata"][k]
                valid = there if nodata is None else there & np.any([cells(values[b]) != nodata for b in bands], axis=0)
                raw = [cells(values[b]) for b in colour]
                total = {"n_pixels": there, "n_valid": valid}
                for how, divisor in (("raw", 1.0), ("scaled", full_scale)):
                    scaled = [v / divisor for v in raw]
                    total[f"dark_{how}"] = sum((v <= black).astype("int64") for v in scaled) * there
                    grey = sum(np.clip(v, 0.0, 1.0) for v in scaled) / len(scaled)
                    total[f"murky_{how}"] = ((grey >= rules.cloud) | (grey <= rules.shadow)) & there
                n = there.sum(axis=1)
                keep = np.flatnonzero(n)
                out["max_value"] += np.where(there, np.max(raw, axis=0), -np.inf).max(axis=1)[keep].tolist()
                for c in names:
                    out[c] += total[c].sum(axis=1)[keep].tolist()
                for c in ("scene_id", "width", "height"):
                    out[c] += [given[c][k]] * len(keep)
                out["by"] += (given["block_row"][k] * block + keep // per * cell).tolist()
                out["bx"] += (given["block_col"][k] * block + keep % per * cell).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return tiling.windows_of_cells(joined.mapInArrow(count, schema), size, stride, len(colour), whole=cell == size)


def chips_of_blocks(blocks: DataFrame, bands: Sequence[str], block: int, size: int, overlap: int = 0) -> DataFrame:
    """(tile keys, chip) of every window, as embedding.tile_chips gives it.

    Windows that are blocks are read off them where they are. Of others, blocks give the packed pieces that lie
    in each window, and a window is put together from its pieces: four at most if it is no larger than a block.
    """
    stride = tiling.stride_of(size, overlap)
    rows = blocks.select(*BLOCK_KEYS, "seen", *bands)
    kind = rows.schema["scene_id"].dataType.simpleString()
    keys = f"scene_id {kind}, tile_row long, tile_col long"

    def chip(seen: np.ndarray, values: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([v[seen] for v in values], axis=-1).ravel()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // (8 * block * block * len(bands)))
        for batch in (given.slice(first, step) for given in batches for first in range(0, given.num_rows, step)):
            chips = [chip(seen, list(values.values())) for _, seen, values in _opened(batch, bands, block)]
            ends = np.cumsum([0, *map(len, chips)]).astype("int32")
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *chips])))
            places = [pa.array(np.asarray(batch.column(c)) * block, pa.int64()) for c in ("block_row", "block_col")]
            yield pa.RecordBatch.from_arrays([batch.column("scene_id"), *places, packed], ["scene_id", "tile_row", "tile_col", "chip"])

    if size == stride == block:
        return rows.mapInArrow(whole, f"{keys}, chip array<double>")

    def starts(number: int) -> range:
        """Window offsets along an axis that meet a block."""
        first = max(0, (number * block - size) // stride + 1)
        return range(first * stride, (number + 1) * block, stride)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column("scene_id").type, *[pa.int64()] * 5, pa.binary()]
            scene, br, bc = (batch.column(c).to_pylist() for c in BLOCK_KEYS)
            out: dict[str, list] = {c: [] for c in ("scene_id", "tile_row", "tile_col", "top", "left", "height", "piece")}
            held = 0
            for k, seen, values in _opened(batch, bands, block):
                layers = np.stack([seen.astype("float64"), *values.values()])
                for y, x in itertools.product(starts(br[k]), starts(bc[k])):
                    top, left = max(0, br[k] * block - y), max(0, bc[k] * block - x)
                    a, b = y + top - br[k] * block, x + left - bc[k] * block
                    piece = layers[:, a : a + size - top, b : b + size - left]
                    if piece.size and piece[0].any():
                        for c, v in zip(out, (scene[k], y, x, top, left, piece.shape[1], piece.tobytes()), strict=True):
                            out[c].append(v)
                        held += piece.nbytes
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))
                        out, held = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def join(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        layers = np.zeros((1 + len(bands), size, size))
        for top, left, height, piece in zip(pieces["top"], pieces["left"], pieces["height"], pieces["piece"], strict=True):
            part = np.frombuffer(piece).reshape(1 + len(bands), height, -1)
            layers[:, top : top + height, left : left + part.shape[2]] = part
        return pd.DataFrame({"scene_id": [key[0]], "tile_row": [key[1]], "tile_col": [key[2]], "chip": [chip(layers[0] > 0, list(layers[1:]))]})

    pieces = rows.mapInArrow(cut, f"{keys}, top long, left long, height long, piece binary")
    return pieces.groupBy(*tiling.TILE_KEYS).applyInPandas(join, f"{keys}, chip array<double>")


def window_of_blocks(blocks: DataFrame, row: int, col: int, bands: Sequence[str], block: int, size: int) -> DataFrame:
    """(scene_id, y, x, bands) of one window of every scene given; filters on block numbers reach the scan."""
    inside = F.col("block_row").between(row // block, (row + size - 1) // block)
    inside &= F.col("block_col").between(col // block, (col + size - 1) // block)
    rows = blocks.filter(inside).select(*BLOCK_KEYS, "seen", *bands)
    kind = rows.schema["scene_id"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scene, br, bc = (batch.column(c).to_pylist() for c in BLOCK_KEYS)
            for k, seen, values in _opened(batch, bands, block):
                y, x = np.nonzero(seen)
                ys, xs = y + br[k] * block, x + bc[k] * block
                keep = (ys >= row) & (ys < row + size) & (xs >= col) & (xs < col + size)
                own = pa.array([scene[k]] * int(keep.sum()), batch.column("scene_id").type)
                arrays = [own, pa.array(ys[keep]), pa.array(xs[keep]), *(pa.array(values[b][y[keep], x[keep]]) for b in bands)]
                yield pa.RecordBatch.from_arrays(arrays, ["scene_id", "y", "x", *bands])

    return rows.mapInArrow(unpack, f"scene_id {kind}, y long, x long, " + ", ".join(f"`{b}` double" for b in bands))
