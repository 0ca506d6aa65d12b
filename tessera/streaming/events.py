"""Structured Streaming: event windows, and ingestion batch by batch with quality gate, ledger and marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, keys: list[str], length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; works on streams (with the watermark) and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def sliding_rate(events: DataFrame, ts: str, key: str, length: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    rows = events.withWatermark(ts, length) if events.isStreaming else events
    return rows.groupBy(F.window(ts, length, step), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each record once, within the watermark on streams."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def ingest(stream: DataFrame, checkpoint: str, accept: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], available_now: bool = True):
    """Runs judged batches through write(passed, held, batch): only rows with status PASS are published.

    accept gives each batch a status; offsets are kept at the checkpoint, so a batch that is run again has the same rows and
    the same number, by which write can stay idempotent.
    """

    def batch(df: DataFrame, number: int) -> None:
        judged = accept(df)
        write(judged.where("status = 'PASS'"), judged.where("status <> 'PASS'"), number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(spark: SparkSession, path: str, pattern: str, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, so many at a time."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)
