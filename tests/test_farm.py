"""Advice on small tables, with values worked out by hand."""

from pyspark.sql import functions as F

from tessera.operators import farm

CALENDAR = "crop_id string, season_id string, stage_id string, month_start int, month_end int, note string, ord int"


def calendar(spark):
    rows = [("RICE", "KHARIF", "STAGE_NURSERY", 5, 6, None, 1), ("RICE", "KHARIF", "STAGE_TRANSPLANTING", 7, 7, None, 2), ("RICE", "KHARIF", "STAGE_HARVEST", 11, 1, "late", 3), ("RICE", "RABI", "STAGE_SOWING", 12, 12, None, 4), ("WHEAT", "RABI", "STAGE_SOWING", 11, 11, None, 5)]
    over = [("RICE", "KHARIF", "STAGE_NURSERY", 4, 4, "d", 10, "S1", "D1"), ("RICE", "KHARIF", "STAGE_NURSERY", 6, 6, "s", 11, "S1", None), ("WHEAT", "RABI", "STAGE_SOWING", 10, 10, "s", 12, "S1", ""), ("WHEAT", "RABI", "STAGE_SOWING", 9, 9, "s2", 13, "S1", "")]
    return spark.createDataFrame(rows, CALENDAR), spark.createDataFrame(over, f"{CALENDAR}, state_code string, district_code string")


def names(spark):
    return spark.createDataFrame([("STAGE_NURSERY", "Nursery")], "stage_id string, name string"), spark.createDataFrame([("KHARIF", "Kharif")], "season_id string, name string")


def test_crop_plans(spark):
    base, over = calendar(spark)
    asked = spark.createDataFrame([(1, "RICE", None, None), (2, "RICE", "S1", "D1"), (3, "RICE", "S1", "D9"), (4, "WHEAT", "S1", None), (5, "OATS", "S1", "D1")], "id int, crop_id string, state_code string, district_code string")
    got = {r["id"]: r for r in farm.crop_plans(asked, base, over, *names(spark)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["sow_window"] == [6, 7, 12, 5] and got[1]["harvest_window"] == [11, 12, 1] and got[1]["duration_months"] == 6 and got[1]["seasons"] == ["Kharif", "RABI"]
    assert got[2]["sow_window"] == [7, 12, 4] and got[2]["timeline"][0]["stage"] == "Nursery" and got[3]["sow_window"] == [6, 7, 12] and got[4]["sow_window"] == [9]


def test_crops_to_sow(spark):
    base, over = calendar(spark)
    asked = spark.createDataFrame([(1, 6, None, None), (2, 4, "S1", "D1"), (3, 5, "S1", "D1"), (4, 9, "S1", None), (5, 11, "S1", None)], "id int, month int, state_code string, district_code string")
    crops = spark.createDataFrame([("RICE", "Rice")], "crop_id string, name string")
    got = sorted((r["id"], r["crop"], r["season"], tuple(r["sow_months"])) for r in farm.crops_to_sow(asked, base, over, crops, names(spark)[1]).collect())
    assert got == [(1, "Rice", "Kharif", (5, 6)), (2, "Rice", "Kharif", (4,)), (4, "WHEAT", "RABI", (9,))]


def test_overrides_of_a_place_meet_requests_as_one_row_a_stage(spark):
    """8 000 overrides of two stages in one state and district are four rows, by level and stage, for each request."""
    base, _ = calendar(spark)
    i = F.col("id")
    stage = F.when(i % 2 == 0, "STAGE_NURSERY").otherwise("STAGE_SOWING")
    over = spark.range(8000).select(F.lit("RICE").alias("crop_id"), F.lit("KHARIF").alias("season_id"), stage.alias("stage_id"), (i % 12 + 1).cast("int").alias("month_start"), (i % 12 + 1).cast("int").alias("month_end"), F.lit(None).cast("string").alias("note"), (i + 10).cast("int").alias("ord"), F.lit("S1").alias("state_code"), F.when(i < 4000, "").otherwise("D1").alias("district_code"))
    asked = spark.range(1200).select(i, (i % 12 + 1).cast("int").alias("month"), F.lit("S1").alias("state_code"), F.lit("D1").alias("district_code"))
    assert farm._overriding(asked.where("id < 3"), over, []).count() == 3 * 4
    crops = spark.createDataFrame([("RICE", "Rice")], "crop_id string, name string")
    got = farm.crops_to_sow(asked, base, over, crops, names(spark)[1]).join(asked, "id").groupBy("month", "crop", "season", "sow_months").agg(F.count("*").alias("n"))
    assert {(r["month"], r["crop"], r["season"], *r["sow_months"], r["n"]) for r in got.collect()} == {(7, "Rice", "Kharif", 7, 100), (8, "Rice", "Kharif", 8, 100), (11, "WHEAT", "RABI", 11, 100), (12, "Rice", "RABI", 12, 100)}


def test_crops_to_sow_of_repeated_and_missing_ids(spark):
    base, over = calendar(spark)
    asked = spark.createDataFrame([(1, 6, None, None), (1, 6, None, None), (1, 11, "S1", None), (None, 6, None, None), (2, 6, None, None), (3, None, "S1", "D1")], "id int, month int, state_code string, district_code string")
    crops = spark.createDataFrame([("RICE", "Rice")], "crop_id string, name string")
    got = sorted((r["id"], r["crop"], r["season"], tuple(r["sow_months"])) for r in farm.crops_to_sow(asked, base, over, crops, names(spark)[1]).collect())
    assert got == [(1, "Rice", "Kharif", (6,)), (2, "Rice", "Kharif", (5, 6))]


def test_sow_risk_and_timing(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    window = F.array(F.lit(6), F.lit(7))
    assert [one(farm.sow_risk(window, F.lit(m))) for m in (6, 5, 4, 8)] == ["on_window", "near_window", "near_window", "off_window"]
    assert one(farm.sow_risk(F.array().cast("array<int>"), F.lit(1))) == "unknown"
    assert [one(farm.timing_of(F.lit(x))) for x in ("Fruit set", "flowering early", "Sowing", "other", None)] == ["reproductive", "reproductive", "basal", None, None]


RULES = "parameter string, label string, unit string, kind string, low_max double, high_min double, adjustment double, nutrient_form string, low_note string, high_note string, ord int"


def test_fertilizer_plans(spark):
    rules = spark.createDataFrame([("available_n", "N", "kg", "nutrient", 280.0, 560.0, 0.25, "N", "low", "high", 2), ("ph", "pH", "", "condition", 6.5, 7.5, None, None, "lime", "gypsum", 1), ("zn", "Zn", "ppm", "micro", 0.6, None, None, None, "zinc", None, 3), ("ec", "EC", "", "condition", 1.0, 2.0, None, None, None, "salt", 4)], RULES)
    tests = spark.createDataFrame([(1, "available_n", 100.0), (1, "ph", 6.0), (2, "available_n", 600.0), (2, "zn", 0.6), (2, "ec", 1.5), (3, "available_n", None)], "id int, parameter string, value double")
    need = spark.createDataFrame([("RICE", "N", 100.0, 0.5, 0.5, 0.0), ("RICE", "P2O5", 46.0, 1.0, 0.0, 0.0), ("RICE", "K2O", 60.0, 1.0, 0.0, 0.0)], "crop_id string, form string, total_kg_ha double, basal double, vegetative double, reproductive double")
    made = spark.createDataFrame([("FERT_UREA", "n", 46.0), ("FERT_DAP", "N", 18.0), ("FERT_DAP", "P2O5", 46.0), ("FERT_SSP", "P2O5", 16.0), ("FERT_MOP", "K2O", 60.0)], "fertilizer_id string, form string, percent double")
    called = spark.createDataFrame([("FERT_UREA", "Urea")], "fertilizer_id string, name string")
    asked = spark.createDataFrame([(1, "RICE"), (2, "RICE"), (3, "RICE"), (4, "OATS")], "id int, crop_id string")
    rows = farm.fertilizer_plans(asked, need, tests, rules, made, called, "v1").collect()
    got = {(r["id"], r["nutrient_form"], r["timing"]): r for r in rows}
    assert set(got) == {(i, f, t) for i in (1, 2, 3) for f, t in (("N", "basal"), ("N", "vegetative"), ("P2O5", "basal"), ("K2O", "basal"))}
    assert got[(1, "P2O5", "basal")]["product_kg_ha"] == 100.0 and got[(1, "K2O", "basal")]["product_kg_ha"] == 100.0 and got[(3, "K2O", "basal")]["soil_status"] == "not tested"
    assert got[(1, "N", "basal")]["recommended_kg_ha"] == 62.5 and got[(1, "N", "basal")]["product_kg_ha"] == round((125 - 18) / 0.46 / 2, 2) and got[(1, "N", "basal")]["soil_status"] == "pH=acidic; N=low"
    assert got[(2, "N", "basal")]["product_kg_ha"] == round((75 - 18) / 0.46 / 2, 2) and got[(2, "N", "basal")]["soil_status"] == "N=high; Zn=sufficient; EC=saline" and got[(2, "N", "basal")]["product_name"] == "Urea"
    assert got[(1, "N", "basal")]["advisory_id"] == "v1:RICE:N:basal"


def test_agromet_advisories(spark):
    weather = "struct<temp_max:double,temp_min:double,humidity:double,wind:double,rainfall:string>"
    bulletins = spark.createDataFrame([("Pune", "Maharashtra", (41.0, 20.0, 85.0, 5.0, "Light to moderate rain"), ["Tomato"], 1), ("Nashik Rural", "Maharashtra", (30.0, 10.0, 50.0, 30.0, "Very heavy rain"), ["Onion"], 2)], f"district string, state string, weather {weather}, crops array<string>, ord int")
    rules = spark.createDataFrame([(1, "heat_stress", "temp_max", ">=", 40.0, "high", "n"), (2, "cold_night", "temp_min", "<=", 10.0, "medium", "n"), (3, "waterlogging", "rainfall_mm", ">=", 60.0, "high", "n"), (4, "dry_spell", "rainfall_mm", "<", 10.0, "high", "n")], "ord int, flag string, metric string, operator string, threshold double, severity string, note string")
    needs = spark.createDataFrame([("tomato", 40.0), ("onion", 30.0)], "crop string, mm_week double")
    asked = spark.createDataFrame([(1, " pune ", "Tomato"), (2, "nashik", "onion"), (3, "Elsewhere", "Tomato"), (4, "pune", "Rice")], "id int, district string, crop string")
    got = {r["id"]: r for r in farm.agromet_advisories(asked, bulletins, rules, needs, F.lit(12)).collect()}
    assert (got[1]["flags"], got[1]["water"], got[1]["risks"], got[1]["data_source"]) == (["heat_stress (high)"], "excess", ["bulletin"], "bulletin")
    assert (got[2]["district"], got[2]["flags"], got[2]["water"]) == ("Nashik Rural", ["cold_night (medium)", "waterlogging (high)"], "excess")
    assert (got[3]["data_source"], got[3]["flags"], got[3]["water"], got[3]["risks"]) == ("synthetic", ["dry_spell (high)"], "deficit", ["favourable"])
    assert got[4]["water"] == "unknown" and got[4]["risks"] == []
    assert [spark.range(1).select(farm.rain_text(F.lit(x)).alias("t")).first()["t"][:5] for x in (20.0, 3.0, 2.0)] == ["Moder", "Light", "Dry c"]
