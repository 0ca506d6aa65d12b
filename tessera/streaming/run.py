"""Runs a stream to its present end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.sources.shared import shared_folder
from tessera.streaming.events import ingest


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source has no more, as a table."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def published(stream: DataFrame, accept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that pass, each batch under its own number, so that one that runs twice is written once."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(passed: DataFrame, held: DataFrame, number: int) -> None:
        passed.select(*stream.columns).write.mode("overwrite").parquet(f"{path}/published/batch={number}")
        held.write.mode("overwrite").parquet(f"{path}/held/batch={number}")

    ingest(stream, f"{path}/offsets", accept, write).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/published").select(*stream.columns)
