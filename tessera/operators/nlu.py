"""Multinomial naive Bayes over tables, and gazetteer tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import BROADCAST_ROWS, if_small, kept


#: Labels that a model may have: each is a column while rows are scored.
MOST_LABELS = 1000


def train(examples: DataFrame, label: str, features: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Priors (label, prior, unseen) and likelihoods (label, f, logp) from rows with a label and an array of features.

    The examples are read once for the counts of features, which are kept as a table, and once for those of labels.
    """
    each = examples.select(F.col(label).alias("label"), F.explode(features).alias("f"))
    counts = kept(each.groupBy("label", "f").agg(F.count("*").alias("n")), "counts")
    vocabulary = counts.select("f").distinct().count()
    totals = counts.groupBy("label").agg(F.sum("n").alias("t"))
    classes = kept(examples.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c")), "classes")
    all_ = classes.agg(F.sum("c")).scalar()
    denominator = F.coalesce(F.col("t"), F.lit(0)) + alpha * vocabulary
    priors = classes.join(totals, "label", "left").select("label", F.log(F.col("c") / all_).alias("prior"), F.log(alpha / denominator).alias("unseen"))
    likelihoods = counts.join(totals, "label").select("label", "f", F.log((F.col("n") + alpha) / (F.col("t") + alpha * vocabulary)).alias("logp"))
    return priors, likelihoods


def predict(rows: DataFrame, id_: str, features: str, priors: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """(id, label, confidence): the likeliest label, ties to the first by name. Features that a label lacks count as unseen.

    Scores start from all features unseen and are corrected where they were seen. The model has one row for each feature with
    a gain for each label; up to a counted size it is broadcast, and sums are built where the rows are.
    """
    labels = priors.orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not labels:
        return rows.select(id_, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence")).limit(0)
    gain = [F.coalesce(F.max(F.when(F.col("label") == r["label"], F.col("logp") - F.lit(r["unseen"]))), F.lit(0.0)).alias(f"g{j}") for j, r in enumerate(labels)]
    model = kept(likelihoods.groupBy("f").agg(*gain), "model")
    model = if_small(model, BROADCAST_ROWS // len(labels))
    each = rows.select(id_, F.explode_outer(features).alias("f"))
    sums = [F.sum(F.coalesce(f"g{j}", F.lit(0.0))).alias(f"s{j}") for j in range(len(labels))]
    summed = each.join(model, "f", "left").groupBy(id_).agg(F.count("f").alias("m"), *sums)
    scores = F.array(*[F.struct((F.lit(r["prior"]) + F.col("m") * F.lit(r["unseen"]) + F.col(f"s{j}")).alias("score"), F.lit(-j).alias("order"), F.lit(r["label"]).alias("label")) for j, r in enumerate(labels)])
    best = summed.select(id_, scores.alias("all")).withColumn("best", F.array_max(F.transform("all", lambda x: F.struct(F.round(x["score"], 9).alias("score"), x["order"].alias("order"), x["label"].alias("label")))))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("best.score")))
    return best.select(id_, F.col("best.label").alias("label"), (1.0 / total).alias("confidence"))


def keyword_intent(text, keywords: dict[str, tuple[str, ...]], default: str = "general"):
    """The intent with the most keywords in a text, the first of the dictionary on ties."""
    lower = F.lower(text)
    counts = [F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))) for words in keywords.values()]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(default)
    for intent, n in reversed(list(zip(keywords, counts, strict=True))):
        out = F.when((n == top) & (top > 0), intent).otherwise(out)
    return out
