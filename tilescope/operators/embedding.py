"""Embedding images and texts with a caller-supplied model.

A model is a picklable factory: called once per task process, it returns a
function from a list of inputs to a 2-d array. The two factories below are
plain deterministic examples, useful for tests; real use passes a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.config import ZERO_NORM
from tilescope.operators.matching import match_images

Model = Callable[[list], np.ndarray]
ModelFactory = Callable[[], Model]

AT_ONCE = 256


def _run(values: Column, factory: ModelFactory) -> Column:
    """Unit-length model output; the norm is clamped away from zero. A model is given AT_ONCE inputs at most."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            parts = [pa.array([], pa.list_(pa.float64()))]
            for first in range(0, len(batch), AT_ONCE):
                inputs = batch.slice(first, AT_ONCE).to_numpy(zero_copy_only=False).tolist()
                out = np.asarray(model(inputs), dtype="float64")
                length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), ZERO_NORM)
                parts.append(pa.array(list(out / length), pa.list_(pa.float64())))
            yield pa.concat_arrays(parts)

    return embed(values)


def tile_chips(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """(keys, chip): pixel values of a tile, row-major with bands together.

    A chip is one tile, so its size is fixed by the tile size. Copies of a pixel
    count once; of unequal ones the largest bands stand, one by one.
    """
    single = pixels.groupBy(*keys, "y", "x").agg(*[F.max(F.col(b).cast("double")).alias(b) for b in bands])
    record = F.struct("y", "x", F.array(*bands).alias("v"))
    ordered = F.sort_array(F.collect_list(record))
    return single.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda r: r["v"])).alias("chip"))


def to_8bit(chips: DataFrame, full_scale: float = 255.0, chip: str = "chip") -> DataFrame:
    """Chips as 0..255 image values: unit-scaled if their maximum exceeds 1, clipped, then whole numbers."""
    divisor = F.when(F.array_max(chip) > 1.0, F.lit(full_scale)).otherwise(F.lit(1.0))
    scaled = chips.withColumn("__d", divisor)
    level = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.col("__d"))) * 255.0)
    return scaled.withColumn(chip, F.transform(chip, lambda v: level(v).cast("double"))).drop("__d")


def embed_tiles(chips: DataFrame, factory: ModelFactory, chip: str = "chip") -> DataFrame:
    """Replace each chip by its unit-length embedding."""
    return chips.withColumn("embedding", _run(F.col(chip), factory)).drop(chip)


def embed_text(texts: DataFrame, factory: ModelFactory, text: str = "text") -> DataFrame:
    """Replace each text by its unit-length embedding."""
    return texts.withColumn("embedding", _run(F.col(text), factory)).drop(text)


class BandHistogramEmbedder:
    """Example image embedder: band means and a histogram of all values."""

    def __init__(self, n_bands: int, bins: int = 8, top: float = 256.0):
        self.n_bands, self.bins, self.top = n_bands, bins, top

    def __call__(self) -> Model:
        return self.encode

    def encode(self, chips: list) -> np.ndarray:
        out = []
        for chip in chips:
            values = np.asarray(chip, dtype="float64")
            means = values.reshape(-1, self.n_bands).mean(axis=0) / self.top
            place = np.clip(values * self.bins / self.top, 0, self.bins - 1).astype("int64")
            out.append(np.concatenate([means, np.bincount(place, minlength=self.bins) / len(values)]))
        return np.array(out)


class LetterCountEmbedder:
    """Example text embedder: how often each letter a..z occurs in the whole text."""

    def __call__(self) -> Model:
        return self.encode

    def encode(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), 26))
        for i, text in enumerate(texts):
            codes = np.bincount(np.frombuffer(text.encode("utf-8"), dtype="uint8"), minlength=256)
            out[i] = codes[97:123] + codes[65:91]
        return out


def embed_matched(
    first: DataFrame, second: DataFrame, tile_keys: Sequence[str], bands: Sequence[str], factory: ModelFactory
) -> DataFrame:
    """(tile_keys, embedding) of the second image after matching its histograms to the first.

    Put in place of the stored second vector, this scores change on radiometrically
    matched pixels; stored vectors are those of the images as taken.
    """
    matched = match_images(first, second, tile_keys, bands)
    return embed_tiles(tile_chips(matched, tile_keys, bands[:3]), factory)


def one_vector(spark: SparkSession, value: object, kind: str, factory: ModelFactory) -> list[float]:
    """The unit-length vector of one text or chip: a single row, run where models run."""
    row = spark.createDataFrame([(value,)], f"value {kind}")
    return list(row.select(_run(F.col("value"), factory).alias("v")).first()["v"])
