"""Pictures to candidates: what their colours speak for, found in the words of an ontology, or a model's classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.sources.shared import if_small


def ontology(diseases: DataFrame, pests: DataFrame, deficiencies: DataFrame) -> DataFrame:
    """(entity_id, kind, name, crop_id, crop, text) of three tables (id, name, crop_id, crop, symptoms); a pest has no crop of its own, but hosts."""
    take = lambda rows, kind, crop_id: rows.select(F.col("id").alias("entity_id"), F.lit(kind).alias("kind"), "name", crop_id.alias("crop_id"), "crop", F.col("symptoms").alias("text"))
    none = F.lit(None).cast("string")
    return take(diseases, "disease", F.col("crop_id")).unionByName(take(pests, "pest", none)).unionByName(take(deficiencies, "deficiency", F.col("crop_id")))


def candidates(pictures: DataFrame, entities: DataFrame, top: int | None = None) -> DataFrame:
    """(id, entity_id, kind, name, score, matched, rank) for pictures (id, data, crop_id, crop); best score first, then kind and name.

    Words of a picture meet the entities' texts word by word: two for a whole word, one for a part. With a crop only entities of it,
    or whose crop's name holds its name as words, count. Pictures that can't be read have no candidates.
    """
    seen = pictures.select("id", "crop_id", "crop", images.described(images.colours("data")).alias("words")).where("size(words) > 0")
    known = if_small(entities.withColumn("text_", F.concat_ws(" ", "text", "name")))
    words = seen.select("id", F.explode("words").alias("w_")).select("w_").distinct()
    hit = words.join(known.select("entity_id", "text_"), F.contains(F.lower("text_"), "w_")).select("w_", "entity_id", (F.size(images.word_matches(F.array("w_"), F.col("text_"))) > 0).alias("whole"))
    met = seen.select("id", "crop_id", "crop", F.explode("words").alias("w_")).join(hit, "w_").join(known.select("entity_id", "kind", "name", F.col("crop_id").alias("e_id"), F.col("crop").alias("e_crop")), "entity_id")
    named = F.regexp_like(F.lower("e_crop"), F.concat(F.lit("\\b\\Q"), F.lower("crop"), F.lit("\\E\\b")))
    fits = (F.col("crop_id").isNull() & F.col("crop").isNull()) | F.coalesce(F.col("crop_id") == F.col("e_id"), F.lit(False)) | F.coalesce(named, F.lit(False))
    scored = met.where(fits).groupBy("id", "entity_id", "kind", "name").agg(F.sum(F.when(F.col("whole"), 2).otherwise(1)).alias("score"), F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("w_")))).alias("matched"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "kind", "name", "entity_id")))
    return out if top is None else out.where(F.col("rank") <= top)


def classes(probabilities: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """(id, entity_id, kind, name, score, rank) of the top classes of a model's probabilities (id, p: array<double>); classes without a
    label (n, entity_id, kind, name) are left out. Scores are per cent, 2 places."""
    best = probabilities.select("id", F.posexplode("p").alias("n", "p"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "n"))).where(F.col("rank") <= top)
    return ranked.join(if_small(labels), "n").select("id", "entity_id", "kind", "name", F.round(F.col("p") * 100, 2).alias("score"), "rank")
