"""Records put right, places, spans."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import refine, tagging


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_dates(spark):
    df = spark.createDataFrame([(1, "05/02/2026", "2026-01-02"), (2, "soon", None), (3, "2026-02-05", "")], "i int, a string, b string")
    got = {r["i"]: r for r in refine.canonical_dates(df, {"a": "DD/MM/YYYY", "b": None}).collect()}
    assert (got[1]["a"], got[1]["a_raw"], got[1]["b"], got[1]["b_raw"], got[1]["problems"]) == ("2026-02-05", "05/02/2026", "2026-01-02", None, [])
    assert got[2]["a"] == "soon" and got[2]["problems"] == ["a=soon does not parse as DD/MM/YYYY"] and got[3]["problems"] == ["a=2026-02-05 does not parse as DD/MM/YYYY"]
    with pytest.raises(ValueError):
        refine.parsed_as(F.lit("x"), "YY")
    assert [str(one(spark, refine.common_date(F.lit(x)))) for x in ("02/09/2026 10:00:00", "2026-09-02T01:02:03Z", "02-09-2026", "x")] == ["2026-09-02"] * 3 + ["None"]
    assert [one(spark, refine.mark_value(F.lit(x), k)) for x, k in (("02/09/2026", "date"), ("2026-09-02T01:02:03", "datetime"), ("n7", "str"), ("", "date"))] == ["2026-09-02", "2026-09-02T01:02:03", "n7", None]


def test_refined_and_priced(spark):
    df = spark.createDataFrame([("call 9876543210", "x@y.org", "2026/01/02"), ("fine", None, None)], "text string, answer_original string, day string")
    a, b = refine.refined(df, {"day": None}).collect()
    assert (a["text"], a["answer_original"], a["day"], a["pii_kinds"], a["pii_redacted"]) == ("call [redacted]", "[redacted]", "2026-01-02", ["email", "phone"], True) and (b["text"], b["pii_redacted"]) == ("fine", False)
    prices = spark.createDataFrame([(20000.0, "Rs/Tonne"), (2000.0, "INR/quintal"), (5.0, "kg"), (None, None)], "modal_price double, unit string")
    assert [tuple(r) for r in refine.priced_in(prices).collect()] == [(2000.0, "INR/quintal"), (2000.0, "INR/quintal"), (5.0, "kg"), (None, "INR/quintal")]
    assert refine.priced_in(prices, "INR/tonne").first()["modal_price"] == 20000.0 and refine.priced_in(prices, "INR/tonne").collect()[1]["modal_price"] == 20000.0
    assert refine.run_id("r", "T").startswith("r-T-") and refine.run_id() != refine.run_id()
    assert [one(spark, refine.country_code(F.lit(x))) for x in ("India", " BHARAT", "Nepal", None)] == ["IN", "IN", None, None]


def test_places(spark):
    places = spark.createDataFrame([("Baramati", "taluka", "MH", "MH-PUNE", 1), ("Baramati", "village", "MH", "MH-NASHIK", 2), ("Rampur", "village", "UP", "UP-AGRA", 3)], "name string, type string, state_code string, district_code string, ord int")
    known = spark.createDataFrame([("Maharashtra", "Pune", "MH", "MH-PUNE"), ("Maharashtra", "Nashik", "MH", "MH-NASHIK"), ("Uttar Pradesh", "Agra", "UP", "UP-AGRA")], "state string, district string, state_code string, district_code string")
    asked = spark.createDataFrame([(1, "baramati", None, None), (2, "BARAMATI", "maharashtra", "nashik"), (3, "Rampur", "Maharashtra", None), (4, "rampur", None, "Agra"), (5, "none", None, None)], "id int, name string, state string, district string")
    got = {r["id"]: (r["type"], r["district_code"]) for r in refine.subdistricts(asked, places, known).collect()}
    assert got == {1: ("taluka", "MH-PUNE"), 2: ("village", "MH-NASHIK"), 3: (None, None), 4: ("village", "UP-AGRA"), 5: (None, None)}
    pests = spark.createDataFrame([("P1", "Rice; sweet Potato / maize"), ("P2", "")], "pest_id string, hosts string")
    crops = spark.createDataFrame([("R", "rice"), ("P", "Potato"), ("M", "Maize plant")], "crop_id string, name string")
    assert {tuple(r) for r in refine.host_crops(pests, crops).collect()} == {("P1", "R"), ("P1", "P"), ("P1", "M")}


def test_features_and_templates(spark):
    assert one(spark, tagging.tokens(F.lit("My पानांवर leaf-spot, 2x!"))) == ["my", "पानांवर", "leaf", "spot", "2x"]
    assert one(spark, tagging.padded_grams(F.lit("leaf"), 3)) == ["#le", "lea", "eaf", "af$"] and one(spark, tagging.padded_grams(F.lit("le"), 3)) == []
    assert one(spark, tagging.intent_features(F.lit("to sow"))) == ["w:to", "w:sow", "3:#so", "3:sow", "3:ow$"]
    templates = spark.createDataFrame([("sow {crop} in {loc}", "plan"), ("hello", "greet")], "template string, label string")
    slots = spark.createDataFrame([("crop", "rice", 1), ("crop", "wheat", 2), ("crop", "maize", 3), ("loc", "Pune", 1), ("loc", "Agra", 2)], "slot string, value string, n int")
    assert sorted(map(tuple, tagging.filled(templates, slots).collect())) == [("hello", "greet"), ("sow maize in Pune", "plan"), ("sow rice in Pune", "plan"), ("sow wheat in Agra", "plan")]


def test_gazetteer_and_tagger(spark):
    names = spark.createDataFrame([("Sweet Potato", "CROP", 1), ("Rice", "CROP", 2), ("Pune", "LOC", 3), ("brown spots", "SYMPTOM", 4), ("rice", "LOC", 5)], "name string, kind string, ord int")
    words, phrases = tagging.gazetteer(names)
    kinds = {r["token"]: list(r["kinds"]) for r in words.collect()}
    assert kinds["rice"] == ["CROP", "LOC"] and {r["phrase"]: r["kind"] for r in phrases.collect()}["rice"] == "CROP"
    asked = spark.createDataFrame([(1, "My sweet potato has Brown spots!"), (2, "nothing")], "id int, query string")
    assert {tuple(r) for r in tagging.spans_by_phrase(asked, phrases).collect()} == {(1, "CROP", "sweet potato"), (1, "SYMPTOM", "brown spots")}
    values = {"crop": ["rice", "sweet potato", "wheat", "red gram"], "sym": ["brown spots", "yellowing", "leaf curl"], "loc": ["pune", "agra"]}
    rows = tagging.tagged_examples(["my {crop} has {sym}", "weather in {loc}", "sow {crop} in {loc}"], values, {"crop": "CROP", "sym": "SYMPTOM", "loc": "LOC"})
    tagger = tagging.Tagger(kinds).learn(rows)
    assert tagger.tag("my sweet potato has brown spots".split()) == ["O", "B-CROP", "I-CROP", "O", "B-SYMPTOM", "I-SYMPTOM"]
    out = spark.createDataFrame([("Sow red gram in Pune",), (None,)], "q string").select(tagging.spans(tagger, spark)("q").alias("s")).collect()
    assert [(s["kind"], s["text"]) for s in out[0]["s"]] == [("CROP", "red gram"), ("LOC", "pune")] and out[1]["s"] == []
