"""Reranking of retrieved segments by a few features, with fixed or learned weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import overlap, ranked

FEATURES = ("similarity", "tokens", "authority", "title", "bias")


def features(query: Column, text: Column, title: Column, authority: Column, similarity: Column) -> Column:
    """struct of FEATURES, each between 0 and 1."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.struct(zero(similarity).alias("similarity"), overlap(query, text).alias("tokens"), zero(authority).alias("authority"), overlap(query, title).alias("title"), F.lit(1.0).alias("bias"))


def nudged(rows: DataFrame, query_id: str, id_: str, k: int = 10) -> DataFrame:
    """Half the similarity and a thousandth of the authority on top of the score (columns score, f)."""
    return ranked(rows.withColumn("score", F.col("score") + 0.5 * F.col("f.similarity") + 0.001 * F.col("f.authority")).drop("rank"), query_id, id_, k)


def weighted(rows: DataFrame, weights: dict[str, float], query_id: str, id_: str, k: int = 10) -> DataFrame:
    """By a weighted sum of the features."""
    total = F.lit(0.0)
    for name in FEATURES:
        total = total + F.lit(float(weights.get(name, 0.0))) * F.col(f"f.{name}")
    return ranked(rows.withColumn("score", total).drop("rank"), query_id, id_, k)


def learn(pairs: DataFrame, epochs: int = 120, rate: float = 0.2, shrink: float = 0.002, most: int = 100_000) -> dict[str, float]:
    """Weights from pairs (better, worse: structs of FEATURES, ord) by pairwise logistic descent, in their order.

    Golden sets are small: more pairs than `most` are an error, not cut off.
    """
    got = pairs.orderBy("ord").limit(most + 1).select("better", "worse").collect()
    if len(got) > most:
        raise ValueError(f"more than {most} pairs")
    x = np.array([[r["better"][f] - r["worse"][f] for f in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    w = np.zeros(len(FEATURES))
    for _ in range(epochs):
        for d in x:
            w += rate * d / (1 + np.exp(w @ d)) - shrink * w
    return dict(zip(FEATURES, map(float, w), strict=True))
