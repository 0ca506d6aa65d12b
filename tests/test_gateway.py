"""Routing, contexts and evidence on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gateway


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("query", "want"), [("My leaves have spots", "diagnosis"), ("urea dose", "fertilizer"), ("mandi bhav today", "mandi_price"), ("will it rain", "weather"), ("hello", "general"), (None, "general"), ("பூச்சி", "diagnosis")])
def test_intent(spark, query, want):
    assert one(spark, gateway.intent(F.lit(query)))["intent"] == want


def test_lexicon_bonus(spark):
    assert one(spark, gateway.intent(F.lit("rain पीला"), ("पीला",)))["intent"] == "diagnosis"


@pytest.mark.parametrize(("scores", "crop", "ill", "path"), [((0.3, 0, 0), False, False, "hybrid"), ((0, 0, 0), True, True, "hybrid"), ((0, 0.3, 0), True, False, "exploratory"), ((0, 0, 1.0), False, False, "exploratory"), ((0.2, 0.2, 0), False, True, "canonical")])
def test_paths(spark, scores, crop, ill, path):
    assert one(spark, gateway.routed(*map(F.lit, map(float, scores)), F.lit(crop), F.lit(ill))) == path


def test_contexts(spark):
    plan = spark.createDataFrame([(1, "hybrid", ["health_map"], "A"), (2, "exploratory", ["evidence"], "A"), (3, "canonical", ["mandi"], "A"), (4, "blocked", [], "A")], "id int, path string, tasks array<string>, crop string")
    facts = spark.createDataFrame([("A", "health_map", "n1", "fact one", 1.0, 1), ("A", "health_map", "n1", "fact one again", 1.0, 2), ("A", "mandi", "n2", "price", 0.8, 3)], "crop string, task string, title string, text string, weight double, ord int")
    read = spark.createDataFrame([(i, f"d{r}", "x " * 400, r) for i in (1, 2, 3, 4) for r in (1, 2)], "id int, title string, text string, rank int")
    got = [tuple(r) for r in gateway.contexts(plan, facts, read, 2, 10).orderBy("id", "rank").select("id", "kind", "title", "text", "rank").collect()]
    assert got == [(1, "graph", "n1", "fact one", 1), (1, "evidence", "d1", "x x x x x …", 2), (2, "evidence", "d1", "x x x x x …", 1), (2, "evidence", "d2", "x x x x x …", 2), (3, "graph", "n2", "price", 1)]


def test_evidence_for_diagnoses(spark):
    docs = spark.createDataFrame([(1, "tomato leaf blight and spots", ["T"]), (2, "potato leaf blight and spots", ["P", "T"]), (3, "leaf blight of rice", ["R"]), (4, "market news", None)], "id int, text string, crops array<string>")
    cases = spark.createDataFrame([(7, "T", "Tomato", "leaf blight"), (8, None, None, "leaf blight of rice"), (9, "Z", "Zucchini", "leaf")], "case int, crop string, name string, symptoms string")
    got = gateway.evidence_for_diagnoses(docs, cases, id_="id", text="text", crops="crops", case_id="case", crop="crop", crop_name="name", symptoms="symptoms").orderBy("case", "rank").collect()
    assert [(r["case"], r["id"]) for r in got if r["case"] == 7] == [(7, 1), (7, 2)] and [r["id"] for r in got if r["case"] == 8][0] == 3 and not [r for r in got if r["case"] == 9]
