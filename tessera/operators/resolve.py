"""Resolution of names by lookups in order of priority, overlays, thresholds and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, normalise
from tessera.sources.shared import if_small


def resolve(rows: DataFrame, mention: str, lookup: DataFrame, *, contains: bool = True) -> DataFrame:
    """rows with the target and match of the best entry of lookup (key, target, priority, ord).

    Exact keys come first, by priority; else, if asked, keys that contain the mention or lie in it, by priority and ord.
    Distinct mentions are resolved, not rows, so the comparison of parts is names by names.
    """
    names = rows.select(normalise(F.col(mention)).alias("m_")).where("m_ <> ''").distinct()
    entries = lookup.select(normalise(F.col("key")).alias("k_"), "target", "priority", "ord").where("k_ <> ''")
    exact = names.join(if_small(entries), F.col("m_") == F.col("k_")).select("m_", "target", "priority", "ord", F.lit("exact").alias("match"))
    found = exact
    if contains:
        rest = names.join(exact.select("m_").distinct(), "m_", "left_anti")
        part = rest.join(if_small(entries), F.contains("m_", "k_") | F.contains("k_", "m_"))
        found = exact.unionByName(part.select("m_", "target", (F.col("priority") + 100).alias("priority"), "ord", F.lit("part").alias("match")))
    best = found.withColumn("n_", F.row_number().over(Window.partitionBy("m_").orderBy("priority", "ord", "target"))).where("n_ = 1").select("m_", "target", "match")
    return rows.withColumn("m_", normalise(F.col(mention))).join(best, "m_", "left").drop("m_")


def mentions(rows: DataFrame, id_: str, text: str, names: DataFrame) -> DataFrame:
    """(id, target) for each name (name, target) that occurs as whole words; word n-grams meet names in an equi-join.

    n goes through the numbers of words that the names have.
    """
    known = names.where(F.length("name") >= 3).select(normalise(F.col("name")).alias("g_"), "target").where("g_ <> ''")
    lengths = sorted(r[0] for r in known.select(F.size(F.split("g_", " "))).distinct().collect())
    words = F.filter(F.split(normalise(F.col(text)), " "), lambda w: w != "")
    grams = [ngrams(words, n) for n in lengths] or [F.array().cast("array<string>")]
    seen = rows.select(id_, F.explode(F.array_distinct(F.concat(*grams))).alias("g_"))
    return seen.join(if_small(known), "g_").select(id_, "target").distinct()


def overlay(base: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """Base rows under overrides (level, ord): district over state over base; at one level the last in order wins."""
    level = F.when(F.col("level") == "district", 1).when(F.col("level") == "state", 2).otherwise(3)
    both = base.withColumn("level", F.lit("base")).unionByName(overrides, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(level, F.desc("ord"))
    return both.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def banded(values: DataFrame, bands: DataFrame, on: str, value: str) -> DataFrame:
    """values with low, medium or high by their parameter's band (low_max, high_min)."""
    both = values.join(if_small(bands), on)
    status = F.when(F.col(value) <= F.col("low_max"), "low").when(F.col(value) >= F.col("high_min"), "high").otherwise("medium")
    return both.withColumn("status", status)


def alerts(metrics: DataFrame, rules: DataFrame, on: str, value: str) -> DataFrame:
    """Rows of metrics that meet a rule (metric, op, threshold, alert): >= as said, anything else as <=."""
    both = metrics.join(if_small(rules), on)
    return both.where(F.when(F.col("op") == ">=", F.col(value) >= F.col("threshold")).otherwise(F.col(value) <= F.col("threshold")))


def need_status(supply: Column, need: Column) -> Column:
    return F.when(need.isNull() | supply.isNull(), "unknown").when(supply < 0.5 * need, "deficit").when(supply > 1.5 * need, "excess").otherwise("adequate")


def labelled(rows: DataFrame, id_: str, names: DataFrame, name: str, out: str) -> DataFrame:
    """rows with a label by id, or the id where there is none."""
    return rows.join(if_small(names.select(F.col(names.columns[0]).alias("id_"), F.col(name).alias("l_"))), F.col(id_) == F.col("id_"), "left").withColumn(out, F.coalesce("l_", F.col(id_).cast("string"))).drop("id_", "l_")


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a column that no parent has."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
