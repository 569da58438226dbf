"""Versioned tables on a shared file system, and raster files.

There is no table format here, so an update reads one version and writes the
next; the version being read is never overwritten. A version counts once its
commit row is written; data of a failed write is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, data string, source string, batch long, stream string"


class VersionedTable:
    """A Parquet table kept as numbered versions under one folder."""

    def __init__(self, spark: SparkSession, folder: str, partition_by: Sequence[str] = ()):
        self.spark, self.folder, self.partition_by = spark, folder.rstrip("/"), list(partition_by)

    def commits(self) -> list[Row]:
        """One row per committed version, in order."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits/*").collect()
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(rows, key=lambda r: r["version"])

    def versions(self) -> list[int]:
        return [int(r["version"]) for r in self.commits()]

    def read(self, version: int | None = None) -> DataFrame | None:
        known = {int(r["version"]): r["data"] for r in self.commits()}
        if not known:
            return None
        found = self.spark.read.parquet(f"{self.folder}/{known[max(known) if version is None else version]}")
        # Folder names lose their type; partition columns here are text.
        return found.withColumns({c: F.col(c).cast("string") for c in self.partition_by})

    def write(
        self, df: DataFrame, version: int | None = None, source: str | None = None, batch: int | None = None, stream: str | None = None
    ) -> int:
        """Write and commit a version, by default the next one.

        A version that exists is an error, also if another writer committed it
        meanwhile: that writer's version stays. `source` and `batch` name a
        stream's batch, `stream` the query that sent it.
        """
        known = self.versions()
        number = version if version is not None else (known[-1] + 1 if known else 0)
        if number in known:
            raise ValueError(f"version {number} of {self.folder} exists")
        data = f"data/{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.folder}/{data}")
        row = self.spark.createDataFrame([(number, data, source, batch, stream)], COMMIT).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.folder}/commits/v{number:012d}")
        return number

    def has_batch(self, source: str, batch: int, stream: str | None = None) -> bool:
        """Whether a batch is committed; with `stream`, by that query. Commits from before ids were kept count for all."""
        found = [r for r in self.commits() if r["source"] == source and r["batch"] == batch]
        return any(stream is None or r["stream"] in (None, stream) for r in found)

    def update(self, change: Callable[[DataFrame | None], DataFrame]) -> int:
        """Write the next version from the current one."""
        return self.write(change(self.read()))


def read_rasters(spark: SparkSession, folder: str, decode, schema: str, pattern: str = "*") -> DataFrame:
    """Pixels from raster files by a caller's decoder (pandas iterator -> pandas iterator).

    Files are read in parallel by Spark's binaryFile source; the decoder is where
    a raster library would be used.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(decode, schema)
