"""Runs, reranking, scripts and pictures."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import images, script
from tessera.operators import ingest, quality, rerank


def test_run_batch(spark):
    rows = spark.createDataFrame([("a", "2026-01-02", 5.0), ("a", "2026-01-02", 5.0), ("a", "2026-01-02", 6.0), ("b", "2026-01-03", -1.0), ("c", "2026-01-01", 1.0), ("d", "2026-01-05", 2.0)], "k string, day string, v double")
    marks = spark.createDataFrame([("s", "2026-01-01")], "src string, mark string")
    rules = [quality.within("DQ-RANGE", "BLOCK", "v", 0, 100)]
    out = ingest.run_batch(rows.withColumn("src", F.lit("s")), run_id="r1", method="live", key=["k", "day"], order=["v"], rules=rules, marks=marks, mark_key=["src"], mark_value="day")
    card = out.card.first()
    assert (card["n_rows"], card["passed"], card["quarantined"], card["promoted"]) == (4, 2, 2, False)
    assert out.published.count() == 0 and out.quarantine.count() == 2 and out.violations.count() == 2
    assert out.marks.first()["mark"] == "2026-01-05"
    clean = ingest.run_batch(rows.where("k = 'd'").withColumn("src", F.lit("s")), run_id="r2", method="live", key=["k", "day"], order=["v"], rules=rules, marks=marks, mark_key=["src"], mark_value="day")
    assert clean.published.count() == 1 and clean.ledger.first()["promoted"]
    again = ingest.run_batch(rows.where("k = 'd'").withColumn("src", F.lit("s")), run_id="r3", method="live", key=["k", "day"], order=["v"], rules=rules, marks=clean.marks.drop("advanced"), mark_key=["src"], mark_value="day")
    assert again.judged.count() == 0


def test_learned_reranker(spark):
    s = "similarity double, tokens double, authority double, title double, bias double"
    pairs = spark.createDataFrame([(i, (0.1, 1.0, 0.0, 0.5, 1.0), (0.9, 0.0, 0.0, 0.0, 1.0)) for i in range(20)], f"ord int, better struct<{s.replace(' double', ':double')}>, worse struct<{s.replace(' double', ':double')}>")
    w = rerank.learn(pairs)
    assert w["tokens"] > 0 > w["similarity"] and w["bias"] == 0
    rows = spark.createDataFrame([(1, 7, "leaf blight", "leaf blight note", "t", 0.5, 0.0), (1, 8, "leaf blight", "storage", "t", 0.5, 0.9)], "q int, id int, query string, text string, title string, authority double, sim double")
    f = rows.withColumn("f", rerank.features(F.col("query"), F.col("text"), F.col("title"), F.col("authority"), F.col("sim"))).withColumn("score", F.lit(0.0))
    assert rerank.weighted(f, w, "q", "id", 1).first()["id"] == 7
    assert rerank.nudged(f, "q", "id", 1).first()["id"] == 8


def test_script(spark):
    assert [script.latin(x) for x in ("नमस्ते", "टमाटर", "abc १२")] == ["namaste", "ttamaattar", "abc 12"]
    df = spark.createDataFrame([("पानी दो",), (None,)], "t string").select(script.glossed({"पानी": "water"})(F.col("t")).alias("x"), script.transliterate("t").alias("l"))
    first, second = df.collect()
    assert (first["x"]["text"], first["x"]["coverage"], first["x"]["status"], first["x"]["unknown"]) == ("water do", 0.5, "partial", ["दो"])
    assert second["l"] is None


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = script.sentence_chunks(text, 300, 50)
    assert all(len(c) <= 300 for c in got) and got[0].startswith("Sentence number 0") and got[-1].endswith("199 is here.")
    assert all(b.startswith(a[-50:].lstrip()) for a, b in zip(got, got[1:], strict=False))
    assert script.sentence_chunks("", 10, 2) == [] and len(script.sentence_chunks("x" * 35, 10, 2)) >= 4
    assert spark.createDataFrame([("A. B.",), (None,)], "t string").select(script.chunks("t")).first()[0] == ["A. B."]


def png(pixels, kind=0):
    h, w, _ = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    flat, lines = pixels.reshape(h, -1).astype(np.int32), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * 3, np.int32)
        left = np.concatenate((np.zeros(3, np.int32), flat[y, :-3]))
        corner = np.concatenate((np.zeros(3, np.int32), up[:-3]))
        p = left + up - corner
        d = np.abs(np.stack((p - left, p - up, p - corner)))
        guess = [0, left, up, (left + up) // 2, np.choose(d.argmin(0), (left, up, corner))][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pictures(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (9, 7, 3)).astype(np.uint8)
    for kind in range(5):
        assert (images.decode_png(png(pixels, kind)) == pixels).all()
    green = np.zeros((4, 4, 3), np.uint8)
    green[:, :, 1] = 200
    green[0] = (230, 220, 40)
    flat = lambda *c: bytearray(png(np.full((3, 3, 3), c, np.uint8)))
    rows = [(0, bytearray(png(green))), (1, bytearray(b"no")), (2, flat(30, 180, 40)), (3, flat(20, 20, 20)), (4, flat(120, 80, 40)), (5, flat(240, 240, 240))]
    df = spark.createDataFrame(rows, "i int, data binary").select("i", images.colours("data").alias("c")).orderBy("i")
    got = df.withColumn("d", images.described(F.col("c"))).collect()
    assert got[0]["c"]["green"] == 0.75 and got[0]["c"]["yellow"] == 0.25 and got[0]["d"] == [] and got[1]["c"] is None
    assert got[2]["d"] == ["healthy"] and got[3]["c"]["black"] == got[3]["c"]["dark"] == 1.0 and got[3]["d"] == ["black", "sooty", "spots"]
    assert got[4]["d"] == ["brown", "spots", "necrosis", "rust"] and got[5]["d"] == ["white", "powdery", "mildew"]
    assert images.sampled(np.zeros((200, 300, 3), np.uint8)).shape == (67, 100, 3)
    words = F.array(F.lit("spot"), F.lit("leaf"))
    assert spark.range(1).select(images.word_score(words, F.lit("Leaf spots")).alias("s")).first()["s"] == 3
    assert spark.range(1).select(images.word_matches(words, F.lit("Leaf spots")).alias("s")).first()["s"] == ["leaf"]


def test_learned_weights_shrink_by_the_whole_decay(spark):
    s = "similarity:double,tokens:double,authority:double,title:double,bias:double"
    pairs = spark.createDataFrame([(0, (1.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 1.0))], f"ord int, better struct<{s}>, worse struct<{s}>")
    w = 0.0
    for _ in range(3):
        w += 0.2 / (1 + np.exp(w)) - 0.002 * w
    assert abs(rerank.learn(pairs, epochs=3)["similarity"] - w) < 1e-12


def test_vision_candidates(spark):
    from tessera.operators import vision

    flat = lambda *c: bytearray(png(np.full((3, 3, 3), c, np.uint8)))
    pictures = spark.createDataFrame([(1, flat(120, 80, 40), None, None), (2, flat(120, 80, 40), "T", "tomato"), (3, flat(30, 180, 40), None, None), (4, bytearray(b"x"), None, None)], "id int, data binary, crop_id string, crop string")
    table = "id string, name string, crop_id string, crop string, symptoms string"
    entities = vision.ontology(spark.createDataFrame([("d1", "Leaf rust", "W", "wheat", "brown pustules"), ("d2", "Spotting", "T", "tomato", "brownish spots")], table), spark.createDataFrame([("p1", "Mite", None, "tomato; okra", "spots")], table), spark.createDataFrame([("f1", "Zinc", "R", "rice", "white buds")], table))
    got = {(r["id"], r["entity_id"]): (r["score"], r["rank"], list(r["matched"])) for r in vision.candidates(pictures, entities).collect()}
    assert got == {(1, "d1"): (4, 1, ["brown", "rust"]), (1, "d2"): (3, 2, ["spots"]), (1, "p1"): (2, 3, ["spots"]), (2, "d2"): (3, 1, ["spots"]), (2, "p1"): (2, 2, ["spots"])}
    p = spark.createDataFrame([(7, [0.1, 0.6, 0.3])], "id int, p array<double>")
    labels = spark.createDataFrame([(1, "b", "disease", "B"), (0, "a", "pest", "A")], "n int, entity_id string, kind string, name string")
    assert [(r["entity_id"], r["score"], r["rank"]) for r in vision.classes(p, labels).orderBy("rank").collect()] == [("b", 60.0, 1), ("a", 10.0, 3)]
