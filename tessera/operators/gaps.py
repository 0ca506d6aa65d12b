"""What is missing: coverage, unanswered demand, and a register of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up


def gap_id(kind: Column, dimension: Column, key: Column) -> Column:
    return F.concat(F.lit("GAP-"), F.upper(F.left(F.sha2(F.concat_ws(":", kind, dimension, key), 256), F.lit(12))))


def uncovered(wanted: DataFrame, key: str, have: DataFrame, have_key: str) -> DataFrame:
    """Wanted keys that nothing covers, as an anti-join on the key."""
    return wanted.join(have.select(F.col(have_key).alias(key)), key, "left_anti")


def coverage(wanted: DataFrame, key: str, have: DataFrame, have_key: str) -> DataFrame:
    """n wanted, covered, and their ratio (3 places)."""
    w, h = wanted.select(key).distinct(), have.select(F.col(have_key).alias(key)).distinct().withColumn("hit", F.lit(1))
    out = w.join(h, key, "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("covered"))
    return out.withColumn("ratio", half_up(F.try_divide(F.col("covered").cast("double"), F.col("wanted").cast("double")), 3))


def demand(rows: DataFrame, mention: Column, source: Column, high: int, most: int = 50) -> DataFrame:
    """The most frequent unresolved mentions with their sources; severity high from so many on."""
    seen = rows.select(F.lower(F.trim(mention)).alias("mention"), source.alias("source")).where("mention <> ''")
    got = seen.groupBy("mention").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))
    return got.withColumn("severity", F.when(F.col("n") >= high, "high").otherwise("medium")).orderBy(F.desc("n"), "mention").limit(most)


def as_gaps(rows: DataFrame, kind: str, dimension: str, key: Column, severity: Column, n: Column) -> DataFrame:
    k = key.cast("string")
    return rows.select(gap_id(F.lit(kind), F.lit(dimension), k).alias("gap_id"), F.lit(kind).alias("kind"), F.lit(dimension).alias("dimension"), k.alias("key"), severity.alias("severity"), n.cast("long").alias("demand"))


def in_order(gaps: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return gaps.orderBy(rank, F.desc("demand"), "key")


def refresh(register: DataFrame, gaps: DataFrame, now: Column) -> DataFrame:
    """The register after a run: known gaps keep first_seen and status, new ones open; what wasn't seen stays as it was."""
    new = gaps.select("gap_id", F.col("severity").alias("severity_"), F.col("demand").alias("demand_"))
    both = register.join(new, "gap_id", "full_outer")
    return both.select(
        "gap_id",
        F.coalesce("severity_", "severity").alias("severity"),
        F.coalesce("demand_", "demand").alias("demand"),
        F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("demand_").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("first_seen").isNull(), "added").when(F.col("demand_").isNotNull(), "refreshed").otherwise("kept").alias("change"),
    )


def register(gaps: DataFrame, status: str | None = None) -> DataFrame:
    """The register, or its gaps of one status, in the order they are worked on."""
    return in_order(gaps.where(F.col("status") == status) if status else gaps)
