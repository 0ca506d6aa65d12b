"""Exact percentiles by index, without a task that holds or sorts all values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """(key, one column for each share): the value at index floor(n * share) of each key's sorted values, the last at most.

    A histogram of equal ranges between a key's least and largest value says in which range each index falls; only the values
    in those ranges are counted, and cumulated within their range. Nulls take no part.
    """
    x = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null")
    ends = x.groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    width = (F.col("high") - F.col("low")).cast("double")
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = x.join(ends, "k").select("k", "v", "n", place.alias("b"))
    counts = placed.groupBy("k", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))  # at most `buckets` rows a key
    before = F.sum("c").over(Window.partitionBy("k").orderBy("b")) - F.col("c")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * share), F.col("n") - 1).alias("i")) for name, share in shares.items()])
    hits = counts.withColumn("before", before).select("k", "b", "before", "c", F.explode(wanted).alias("w")).where("w.i >= before and w.i < before + c").select("k", "b", "before", "w.name", "w.i")
    there = placed.join(hits.select("k", "b").distinct(), ["k", "b"], "left_semi").groupBy("k", "b", "v").agg(F.count("*").alias("c"))
    upto = there.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "b").orderBy("v")))
    found = upto.join(hits, ["k", "b"]).where("i >= before + upto - c and i < before + upto")
    return found.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares]).withColumnRenamed("k", key)
