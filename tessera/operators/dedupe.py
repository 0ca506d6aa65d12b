"""Duplicates by content, conflicts by business key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Columns that differ from run to run.
VOLATILE = ("ingested_at", "run_id", "record_hash", "quality", "_method", "ingestion_method")


def record_hash(columns: list[str]) -> Column:
    """sha256 of the columns as compact JSON, in the order of their names; those that change with the run, or begin with _, are left out."""
    stable = sorted(c for c in columns if c not in VOLATILE and not c.startswith("_"))
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stable]), {"ignoreNullFields": "false"}), 256)


def split_three(rows: DataFrame, key: list[str], hash_: str, order: list[Column | str]) -> DataFrame:
    """Each row as unique (first of its key), duplicate (same hash as that first) or conflict (another hash).

    Rows without any key part are judged by their hash alone. Equal hashes mean equal keys, so one window decides.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    none = F.lit(True)
    for k in key:
        none = none & F.col(k).isNull()
    by = F.when(none, F.concat(F.lit("#"), F.col(hash_))).otherwise(F.concat(F.lit("="), F.concat_ws("\x1f", *parts)))
    w = Window.partitionBy("by_").orderBy(*order)
    ranked = rows.withColumn("by_", by).withColumn("nth_", F.row_number().over(w)).withColumn("first_", F.first(hash_).over(w))
    kind = F.when(F.col("nth_") == 1, "unique").when(F.col(hash_) == F.col("first_"), "duplicate").otherwise("conflict")
    return ranked.withColumn("kind", kind).drop("by_", "nth_", "first_")


def key_conflicts(rows: DataFrame, key: list[str], hash_: str) -> DataFrame:
    """Keys, all parts given, under which there are several contents."""
    given = rows.where(" and ".join(f"{k} is not null" for k in key))
    return given.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(hash_).alias("n_contents")).where("n_contents > 1")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth_ = 1").drop("nth_")


def quorum(answers: DataFrame, key: list[str], vendor: str, value: str, least: int) -> DataFrame:
    """Keys on which at least two (or `least`) vendors agree on one value."""
    got = answers.groupBy(*key).agg(F.countDistinct(vendor).alias("vendors"), F.countDistinct(F.sha2(F.col(value).cast("string"), 256)).alias("contents"))
    return got.withColumn("agreed", (F.col("vendors") >= max(2, least)) & (F.col("contents") == 1))
