"""Structured Streaming: activity upserts, ingestion by batches, event windows (ST-01, ST-02, ST-07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_activity(events: DataFrame, user: str, document: str, at: str) -> DataFrame:
    """ST-07 on a stream (update mode): last write wins for each user and document."""
    return events.groupBy(user, document).agg(F.max(at).alias("last_activity_at"))


def tumbling(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Beyond parity: counts and sums in event-time windows; rows later than the watermark are left to the source of record."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Beyond parity: session windows."""
    return events.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events"))


def ingest(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """ST-01, ST-02: each batch is written to a folder of its own id, so that a batch that runs again replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
