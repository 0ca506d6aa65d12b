"""Queries to contexts: guarded, routed by intent, answered from facts and evidence, fused, cut. All queries at once, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.sources.shared import if_small

# Words that speak for an intent, in any part of a query; and what a word of a symptom lexicon adds to a diagnosis.
INTENTS = {
    "diagnosis": (
        "disease", "symptom", "symptoms", "spots", "spot", "wilting", "wilt", "yellowing", "yellow", "blight", "pest", "rot", "insect", "borer", "fungus", "fungal", "lesion", "leaf", "leaves", "curling",
        "stunted", "drooping", "infection", "treat", "treatment", "spray", "control", "cure", "problem", "attack", "रोग", "बीमारी", "कीड़ा", "दाग", "धब्बे", "पत्ति", "மருத்துவம்", "நோய்", "பூச்சி", "புள்ளி",
        "వ్యాధి", "చీడ", "మచ్చ", "తెగులు",
    ),
    "fertilizer": (
        "fertilizer", "urea", "dap", "mop", "npk", "nutrient", "dose", "kg", "soil test", "compost", "manure", "fym", "nitrogen", "phosphorus", "potash", "पोटाश", "खत", "उर्वरक", "खाद", "மண்ணு", "உரம்", "எரு",
        "ఎరువు", "ఎరువులు",
    ),
    "mandi_price": (
        "price", "rate", "mandi", "bazaar", "bazar", "market", "quintal", "bhav", "sell", "selling", "मंडी", "भाव", "दाम", "कीमत", "விலை", "சந்தை", "ధర", "మార్కెట్", "మండి",
    ),
    "weather": ("rain", "rainfall", "weather", "temperature", "humidity", "monsoon", "frost", "wind", "storm", "बारिश", "वर्षा", "मौसम", "வானிலை", "மழை", "వర్షం", "వాతావరణం"),
    "crop_planning": ("sow", "sowing", "plant", "planting", "season", "when", "month", "cultivate", "transplant", "बोना", "बुवाई", "मौसम", "விதைக்க", "விதைப்பு", "నాటు", "విత్తనం"),
    "evidence": ("research", "guide", "practice", "paper", "information", "about", "what is", "recommendation", "how to", "अनुसंधान", "जानकारी", "முறை", "வழிகாட்டி", "సమాచారం", "పద్ధతి"),
}
LEXICON_BONUS = 2


def intent(query: Column, lexicon: tuple[str, ...] = ()) -> Column:
    """struct(intent, scores: map): the intent with most of its words in a query, the first on ties; general without any."""
    low = F.lower(F.coalesce(query, F.lit("")))
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) if words else F.lit(0)
    scores = {k: hits(words) + (LEXICON_BONUS * hits(lexicon) if k == "diagnosis" else 0) for k, words in INTENTS.items()}
    top = F.greatest(*scores.values())
    best = F.lit("general")
    for k, n in reversed(scores.items()):
        best = F.when((n == top) & (top > 0), k).otherwise(best)
    return F.struct(best.alias("intent"), F.create_map(*[x for k, n in scores.items() for x in (F.lit(k), n)]).alias("scores"))


def routed(diagnosis: Column, evidence: Column, general: Column, has_crop: Column, has_symptoms: Column) -> Column:
    """hybrid (facts and evidence) for diagnoses, exploratory (evidence) for research and general questions, else canonical (facts)."""
    return F.when((diagnosis >= 0.3) | (has_crop & has_symptoms), "hybrid").when((evidence >= 0.3) | (general >= 0.3), "exploratory").otherwise("canonical")


def tasks(scores: Column, has_crop: Column, has_symptoms: Column) -> Column:
    """What to look up, in this order; evidence if nothing else. scores is a map of intents to shares."""
    s = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    vague = has_crop & (s("general") >= 0.2)
    ill = (s("diagnosis") >= 0.2) | has_symptoms | vague
    found = F.array_compact(F.array(
        F.when(ill, F.lit("health_map")), F.when(ill & has_symptoms, F.lit("symptom_candidates")), F.when(ill, F.lit("evidence")), F.when((s("fertilizer") >= 0.2) | vague, F.lit("fertilizer")),
        F.when(F.greatest(s("crop_planning"), s("crop_plan")) >= 0.2, F.lit("crop_plan")), F.when(F.greatest(s("mandi_price"), s("mandi")) >= 0.2, F.lit("mandi")), F.when(s("weather") >= 0.2, F.lit("weather")),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("evidence")))


def planned(queries: DataFrame, crops: DataFrame, symptoms: DataFrame, query: str = "query") -> DataFrame:
    """queries (id, query) with guard, intent, path, tasks and crop.

    crops (name, crop) are the names that are looked for, the smallest crop counts; symptoms (name) the words for symptoms. Scores are
    shares of all hits; general is 1 where there are none.
    """
    said = queries.withColumn("guard", T.guard(F.col(query))).withColumn("i_", intent(F.col("guard.query")))
    total = F.aggregate(F.map_values("i_.scores"), F.lit(0), lambda a, x: a + x)
    shares = F.when(total > 0, F.transform_values("i_.scores", lambda k, v: v / total)).otherwise(F.create_map(F.lit("general"), F.lit(1.0)))
    words = F.filter(F.split(T.normalise(F.col("guard.query")), " "), lambda w: w != "")
    each = said.select("id", F.explode(F.array_distinct(F.concat(words, T.bigrams(words)))).alias("w_"))
    named = each.join(if_small(crops.select(T.normalise(F.col("name")).alias("w_"), "crop").distinct()), "w_").groupBy("id").agg(F.min("crop").alias("crop"))
    ill = each.join(if_small(symptoms.select(T.normalise(F.col("name")).alias("w_")).distinct()), "w_").groupBy("id").agg(F.array_sort(F.collect_set("w_")).alias("symptoms"))
    both = said.join(named, "id", "left").join(ill, "id", "left").withColumn("symptoms", F.coalesce("symptoms", F.array().cast("array<string>"))).withColumn("scores", shares)
    has_crop, has_symptoms = F.col("crop").isNotNull(), F.size("symptoms") > 0
    s = lambda k: F.coalesce(F.try_element_at("scores", F.lit(k)), F.lit(0.0))
    path = F.when(F.col("guard.blocked"), "blocked").otherwise(routed(s("diagnosis"), s("evidence"), s("general"), has_crop, has_symptoms))
    return both.select("id", F.col("guard.query").alias("query"), "guard", F.col("i_.intent").alias("intent"), path.alias("path"), F.when(F.col("guard.blocked"), F.array().cast("array<string>")).otherwise(tasks(F.col("scores"), has_crop, has_symptoms)).alias("tasks"), "crop", "symptoms")


def contexts(plan: DataFrame, facts: DataFrame, evidence: DataFrame, top: int = 5, longest: int = 480) -> DataFrame:
    """(id, kind, title, text, score, rank): the best segments for each planned query.

    facts (crop, task, title, text, weight, ord) answer tasks about a crop and go by weight, then order; evidence (id, title, text, rank) is
    a ranking of passages for each query. Canonical queries take facts alone, exploratory ones evidence alone, hybrid ones both;
    a segment that comes twice (by kind and title) counts once. Both rankings are fused by reciprocal ranks.
    """
    asked = plan.where("path in ('canonical', 'hybrid')").select("id", "crop", F.explode("tasks").alias("task"))
    hit = asked.join(if_small(facts), ["crop", "task"]).groupBy("id", F.concat(F.lit("graph:"), "task").alias("source"), "title").agg(F.max(F.struct(F.col("weight"), (-F.col("ord")).alias("o"), F.col("text"))).alias("f"))
    order = Window.partitionBy("id").orderBy(F.desc("f.weight"), F.desc("f.o"), "source", "title")
    graph = hit.withColumn("r", F.row_number().over(order)).select("id", F.lit("graph").alias("kind"), "source", "title", F.col("f.text").alias("text"), "r")
    read = evidence.join(plan.where("path in ('exploratory', 'hybrid')").select("id"), "id", "left_semi")
    papers = read.groupBy("id", "title").agg(F.min_by("text", "rank").alias("text"), F.min("rank").alias("r")).select("id", F.lit("evidence").alias("kind"), F.lit("research").alias("source"), "title", "text", "r")
    both = graph.unionByName(papers).withColumn("score", F.round(1.0 / (retrieval.RRF + F.col("r")), 12))
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("kind"), "title")
    cut = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return cut.select("id", "kind", "title", retrieval.compact(F.col("text"), longest).alias("text"), "score", "rank")


def evidence_for_diagnoses(docs: DataFrame, cases: DataFrame, *, id_: str, text: str, crops: str, case_id: str, crop: str, crop_name: str, symptoms: str, top: int = 3) -> DataFrame:
    """(case_id, id, score, rank): for each case the best documents about its crop (an array column `crops`), by lexical and hashed ranking of crop and symptoms.

    A case without a crop may take any document. Both rankings are over the documents that a case may take.
    """
    asked = cases.select(case_id, F.concat_ws(" ", crop_name, symptoms).alias("q_"))
    allowed = docs.select(id_, F.explode_outer(crops).alias("c_"))
    wanted = cases.select(case_id, F.col(crop).alias("c_"))
    fits = wanted.where("c_ is not null").join(allowed, "c_").select(case_id, id_).distinct()
    free = wanted.where("c_ is null").select(case_id)
    rankings = []
    for found in (retrieval.bm25(docs, asked, id_=id_, text=text, query_id=case_id, query_text="q_", k=None), retrieval.dense(docs, asked, id_=id_, text=text, query_id=case_id, query_text="q_", k=None)):
        kept = found.drop("rank").join(fits, [case_id, id_], "left_semi").unionByName(found.drop("rank").join(free, case_id, "left_semi"))
        rankings.append(retrieval.ranked(kept, case_id, id_, None))
    return retrieval.fuse(rankings, case_id, id_, top)
