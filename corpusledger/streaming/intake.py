"""Incremental intake with Structured Streaming.

The reference semantics are at-least-once with stable ids; watermarked event-time windows are an
addition of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(events: DataFrame, at: str = "ts", key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each id once among events no later than the watermark; state is bounded by it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event-time window and type."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(F.col("window.start").alias("window_start"), kind, "events")


def publish(stream: DataFrame, journal: str, checkpoint: str, subscribers: list[Callable[[DataFrame], None]] = ()) -> StreamingQuery:
    """Journal first, then each subscriber in order; one that fails stops no other.

    The journal's folder is named by the batch, so a batch that is run again overwrites itself.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{journal}/batch={epoch}")
        stored = batch.sparkSession.read.parquet(f"{journal}/batch={epoch}")
        for subscriber in subscribers:
            try:
                subscriber(stored)
            except Exception as error:  # isolated: the journal has the events already
                print(f"subscriber failed on batch {epoch}: {error}")

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
