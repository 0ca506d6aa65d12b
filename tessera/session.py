"""Session construction and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on; further settings by keyword or Spark's own files."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if its scan has fewer tasks than there are cores: a file of one row group is one task.

    For work that costs much more than moving a row. Tables of many files or row groups stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
