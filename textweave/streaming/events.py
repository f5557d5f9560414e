"""Streams: windowed counts over the event log, and files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: str = "ts timestamp, type string") -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes", ts_col: str = "ts", type_col: str = "type") -> DataFrame:
    """(start, type, n); events later than the watermark are left out and their state is freed."""
    w = F.window(ts_col, window)
    rows = events.withWatermark(ts_col, late).groupBy(w, type_col).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col(type_col).alias("type"), "n")


def ingest(docs: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of new documents to upsert, once per batch number, until none are left."""
    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
