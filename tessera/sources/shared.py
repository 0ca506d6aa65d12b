"""The folder that driver and executors share, and tables kept in it while a query runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str = "stream") -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one is set for it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is used, and not again if an executor is lost."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of few columns up to which it may be broadcast.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows; counting stops there. Beyond that Spark joins by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
