"""Incremental segments by Structured Streaming: an extension of batch builds.

New documents arrive as files; each micro-batch becomes one segment of the current snapshot, named
after the batch, so a batch that runs again writes over itself. Searches stay right without it, since
documents that no segment covers are scanned; the stream makes them searchable by index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Index

#: Segments of the stream are numbered from here, apart from those of builds.
FIRST_SEGMENT = 1 << 20


def stream_documents(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they come into ``folder``; the first columns are doc_id and text."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def refresh(index: Index, arriving: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Add a segment for each micro-batch. Stopping and starting with the same checkpoint goes on where
    it stopped, at a batch's boundary."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.append(batch, FIRST_SEGMENT + number)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches of a query log by type and hour, with late rows up to ``late``; for status pages."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
