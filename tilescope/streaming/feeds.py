"""Incremental feeds into the versioned stores.

Ingest and ledger updates are the same merges as in batch, applied to each
micro-batch. A batch adds a version that names its stream and number, so a batch
that is run again after it was committed changes nothing, and versions written
by others stay as they are. A stream is known by the id that its checkpoint
keeps: restarted it is the same, with an emptied checkpoint it is another one,
whose numbers begin again and whose rows are merged again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tilescope.operators import ledger
from tilescope.sources.stores import VersionedTable

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint folder belongs to; Spark writes it before the first batch."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def stream_into(feed: DataFrame, store: VersionedTable, merge: Merge, checkpoint: str) -> StreamingQuery:
    """Merge a streaming feed into a store until the feed has nothing new; the checkpoint folder keeps the stream's id."""

    def apply(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        if not store.has_batch(checkpoint, number, stream):
            store.write(merge(store.read(), batch), source=checkpoint, batch=number, stream=stream)

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_audit(order: Sequence[str]) -> Merge:
    """Audit-ledger merge for stream_into."""

    def merge(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        if stored is None:
            return ledger.reduce_feed(batch, order)
        return ledger.audit_upsert(stored, batch, order)

    return merge


def merge_points(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Point-store merge for stream_into: the highest version of a point wins."""
    return ledger.vector_upsert(batch if stored is None else stored, batch)
