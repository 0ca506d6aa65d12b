"""Reading with declared schemas, falling back by provenance, and writing by key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.shared import if_small


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """With a header; empty cells are null; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def read_json_lines(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Lines of JSON of several files, by name; fields that a file lacks are null."""
    return spark.read.schema(schema).json(paths)


def read_first(spark: SparkSession, choices: list[tuple[str, Callable[[], DataFrame | None]]]) -> DataFrame:
    """The first choice that has rows, labelled with its name in data_source."""
    last = None
    for name, read in choices:
        df = read()
        if df is None:
            continue
        last = df.withColumn("data_source", F.lit(name))
        if not df.isEmpty():
            return last
    if last is None:
        raise ValueError("none of the choices can be read")
    return last


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new. Write it to another place than old is read from."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(new: DataFrame, stored: DataFrame, digest: str) -> DataFrame:
    """New artefacts whose content isn't stored yet."""
    return new.join(stored.select(digest).distinct(), digest, "left_anti").dropDuplicates([digest])


def advance(marks: DataFrame, rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """High-water marks after rows: forward only."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max(value).alias("seen_"))
    both = marks.join(seen, key, "full_outer")
    return both.select(*key, F.greatest("mark", "seen_").alias("mark"), (F.col("seen_").isNotNull() & (F.col("mark").isNull() | (F.col("seen_") > F.col("mark")))).alias("advanced"))


def past_marks(rows: DataFrame, marks: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows beyond their mark; all rows of keys without one."""
    return rows.join(if_small(marks.select(*key, "mark")), key, "left").where(F.col("mark").isNull() | (F.col(value) > F.col("mark"))).drop("mark")


def stamped(rows: DataFrame, run_id: str, method: str, hash_: Column, now: dt.datetime | None = None) -> DataFrame:
    """Provenance columns; methods are live, replay or fixture."""
    if method not in ("live", "replay", "fixture"):
        raise ValueError(f"unknown method {method}")
    at = F.lit(now) if now else F.current_timestamp()
    return rows.withColumns({"run_id": F.lit(run_id), "ingestion_method": F.lit(method), "record_hash": hash_, "ingested_at": at})


class PagedReader(DataSourceReader):
    """Reads pages until one is shorter than the limit. With a declared number of rows each page is a partition of its own."""

    def __init__(self, fetch: Callable[[int, int], list[tuple]], limit: int, most: int | None):
        self.fetch, self.limit, self.most = fetch, limit, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None)] if self.most is None else [InputPartition(offset) for offset in range(0, self.most, self.limit)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from self.fetch(partition.value, min(self.limit, self.most - partition.value))
            return
        offset = 0
        while True:
            page = self.fetch(offset, self.limit)
            yield from page
            if len(page) < self.limit:
                return
            offset += self.limit


def paged_source(name_: str, schema_: str, fetch: Callable[[int, int], list[tuple]], limit: int = 100, most: int | None = None) -> type[DataSource]:
    """A data source class over fetch(offset, limit) -> rows; register it with spark.dataSource.register.

    Without `most` (also an option) all pages are read, one after the other, since only a short page says where the source ends.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema: StructType) -> DataSourceReader:
            told = self.options.get("most", most)
            return PagedReader(fetch, int(self.options.get("limit", limit)), None if told is None else int(told))

    return Paged
