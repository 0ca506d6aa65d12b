"""Reading with declared schemas, sinks, layers, runs that are kept."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import gaps, graph, ingest, quality, silver
from tessera.sources import lake, tables
from tessera.sources.shared import if_small, shared_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "k int, v string")
    assert rows(got) == [(1, "x"), (2, None)]
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n')
    (tmp_path / "b.jsonl").write_text('{"v": "y", "w": 2}\n')
    assert rows(tables.read_json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "k int, v string, w int")) == [(1, "x", None), (None, "y", 2)]
    empty = got.where("false")
    first = tables.read_first(spark, [("lake", lambda: None), ("replay", lambda: empty), ("fixture", lambda: got)])
    assert {r["data_source"] for r in first.collect()} == {"fixture"} and tables.read_first(spark, [("lake", lambda: empty)]).columns == ["k", "v", "data_source"]
    with pytest.raises(ValueError):
        tables.read_first(spark, [("lake", lambda: None)])


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert not tables.exists(spark, "lake_test")
    lake.replace_table(df, "lake_test")
    assert tables.exists(spark, "lake_test")
    assert rows(lake.replace_table(spark.table("lake_test").union(spark.createDataFrame([(2, "b")], df.schema)), "lake_test")) == [(1, "a"), (2, "b")]
    spark.sql("drop table lake_test")
    path = f"file://{tmp_path}/t"
    stored = lake.replace_folder(df, path)
    assert rows(lake.replace_folder(stored.withColumn("v", F.lit("z")), path, "json")) == [(1, "z")]
    out = lake.versioned_csv(df, f"file://{tmp_path}", "report", "2")
    assert out.endswith("report@2") and rows(tables.read_csv(spark, out, "k int, v string")) == [(1, "a")]
    for _ in range(2):
        lake.append_audit(df, f"file://{tmp_path}/audit", "r1")
    lake.append_audit(df, f"file://{tmp_path}/audit", "r2")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 2


def test_bronze_by_content(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    one = spark.createDataFrame([("r", "f", "text", "{}"), ("r", "g", "text", "{}"), ("s", "f", "text", "{}")], "resource_id string, filename string, payload string, meta string")
    assert lake.write_bronze(one, root, source="a").count() == 2 and lake.write_bronze(one, root, source="a").count() == 0 and lake.write_bronze(one, root, source="b").count() == 2
    assert spark.read.parquet(f"{root}/payloads").count() == spark.read.parquet(f"{root}/manifest").count() == 4
    assert lake.readable(spark, f"{root}/nothing") is None


def test_silver_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0, "own"), ("b", None, None, None)], "state string, crop string, v double, source string")
    got = lake.silver(df, run_id="r", method="live", source="s", licence="CC0", authority="research", today=F.lit("2026-01-01").cast("date")).collect()
    assert [r["source"] for r in got] == ["own", "s"] and got[0]["quality"]["quality_score"] == round(0.3 * 0.95 + 0.15 * 0.5 + 0.15 + 0.1 + 0.1 + 0.05, 4) and got[1]["quality"]["crop_specificity"] == 0.0
    assert lake.fingerprint(df) == lake.fingerprint(df.repartition(3).select("v", "source", "state", "crop")) != lake.fingerprint(df.limit(1))
    ran = []
    state = f"file://{tmp_path}/state"
    assert [lake.rebuilt(spark, state, n, [d], lambda: ran.append(1)) for n, d in (("x", df), ("x", df), ("y", df), ("x", df.limit(1)), ("y", df))] == [True, False, True, True, False] and len(ran) == 3
    shape = json.loads(lake.json_schema(df, "rows"))
    assert shape["properties"]["v"] == {"type": "number"} and shape["required"] == []
    snapshot = lake.discovered(df, f"file://{tmp_path}/disc", "s1")
    assert lake.discovered(df.select("v"), f"file://{tmp_path}/disc", "s2").count() == 5 == snapshot.count() + 1


def run(spark, data, marks, run_id):
    rules = [quality.within("DQ-RANGE", "BLOCK", "v", 0, 100)]
    return ingest.run_batch(data, run_id=run_id, method="live", key=["k", "day"], order=["v"], rules=rules, marks=marks, mark_key=["src"], mark_value="day")


def test_persisted_runs(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    data = spark.createDataFrame([("a", "2026-01-02", 5.0), ("b", "2026-01-03", 6.0)], "k string, day string, v double").withColumn("src", F.lit("s"))
    marks = spark.createDataFrame([("s", "2026-01-01")], "src string, mark string")
    for _ in range(2):  # written twice, there once
        first = ingest.persisted(run(spark, data, marks, "r1"), root, "r1")
    assert (first["gold"], first["quarantine"], first["dq_violation"], first["ingest_run"], first["ingest_watermark"]) == (2, 0, 0, 1, 1)
    stored = lambda: spark.read.parquet(f"{root}/ingest_watermark").select("src", "mark")
    again = ingest.persisted(run(spark, data, stored(), "r2"), root, "r2")
    bad = ingest.persisted(run(spark, data.withColumn("day", F.lit("2026-02-01")).withColumn("v", F.lit(-1.0)), stored(), "r3"), root, "r3")
    assert again["gold"] == 0 and bad["gold"] == 0 and bad["quarantine"] == 2 and bad["dq_violation"] >= 2
    assert spark.read.parquet(f"{root}/gold").count() == 2 and spark.read.parquet(f"{root}/ingest_run").count() == 3


def test_register_and_stored_graph(spark, tmp_path):
    g = spark.createDataFrame([("A", "low", 1, "open", "k1"), ("B", "critical", 0, "closed", "k2"), ("C", "high", 5, "open", "k3")], "gap_id string, severity string, demand int, status string, key string")
    assert [r["gap_id"] for r in gaps.register(g).collect()] == ["B", "C", "A"] and [r["gap_id"] for r in gaps.register(g, "open").collect()] == ["C", "A"]
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", "t", "A")], "id string, type string, label string"), spark.createDataFrame([("a", "a", "self")], "source string, target string, type string")

    for _ in range(2):
        nodes, edges = graph.stored(spark, f"file://{tmp_path}/g", build)
    assert nodes.count() == edges.count() == 1 and len(built) == 1


def test_dashboard_bulletins_and_soil(spark):
    crops = spark.createDataFrame([("Tomato", "T", 1, 1), ("tamatar", "T", 2, 2)], "key string, target string, priority int, ord int")
    about = spark.createDataFrame([("T", "Tomato", "Solanum")], "crop_id string, canonical_en string, scientific_name string")
    places = spark.createDataFrame([("Goa", "North Goa", "GA", "GA-N", "coast")], "state string, district string, state_code string, district_code string, agroclimatic_zone string")
    raw = spark.createDataFrame([("Tamatar", "veg", "1,200", "1100", None, "3.5", "", " UP ", "17-03-2026", "goa", "north goa", 7), ("", "", "", "", "", "", "", "", "", "", "", 7)], "cmdt_name string, cmdt_grp_name string, as_on_price string, one_day_ago_price string, two_day_ago_price string, as_on_arrival string, msp_price string, trend string, reported_date string, state_name string, district_name string, district_id int")
    (r,) = silver.dashboard_prices(raw, crops, about, places).collect()
    assert (r["record_id"], r["crop"], r["crop_canonical"], r["modal_price"], r["prev_2day_price"], r["trend"], r["district_code"], r["price_date_raw"], r["market"]) == ("AMND-7-Tamatar-2026-03-17", "T", "Tomato", 1200.0, None, "up", "GA-N", "17-03-2026", None)
    notes = "array<struct<crop:string,growth_stage:string,risk:string,action:string>>"
    said = spark.createDataFrame([("Goa", None, "2026-01-01", "2026-01-05", [("tomato", "g", "r", "a"), ("zzz", None, None, None)], "u"), ("Goa", "x", "2026-02-01", None, [], "u")], f"state string, district string, valid_from string, valid_to string, crop_advisories {notes}, source_url string")
    a, b = sorted(silver.bulletins(said, crops, about, places).collect(), key=lambda x: x["valid_from"])
    assert a["record_id"] == "IMD-Goa-2026-01-01" and [(x["crop"], x["risk"]) for x in a["crop_advisories"]] == [("T", "r"), (None, None)] and a["state_code"] == "GA" and b["crop_advisories"] == []
    card = spark.createDataFrame([("Goa", "North Goa", "s1", "tomato", "none", 6.5, 100.0, "u")], "state string, district string, sample_id string, previous_crop string, target_crop string, pH double, N double, source_url string")
    (c,) = silver.soil_cards(card, crops, about, places).collect()
    assert (c["record_id"], c["previous_crop"], c["target_crop"], c["soil_test"]["pH"], c["soil_test"]["Zn"], c["agroclimatic_zone"]) == ("SHC-Goa-North Goa-s1", "T", None, 6.5, None, "coast")
    assert [spark.range(1).select(silver.season_of(F.lit(x)).alias("s")).first()["s"] for x in ("Late Kharif", "whole year", "none")] == ["kharif", "whole_year", None]


def test_shared_folder(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x") and "/x-" in shared_folder(spark, "x")
    small, large = if_small(spark.range(3), 3), if_small(spark.range(4), 3)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small) and "broadcast" not in plan(large)
