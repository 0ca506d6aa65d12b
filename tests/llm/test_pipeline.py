"""The pipeline's stages, each against what it is to do with its own input."""

import collections

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import secret_scan
from tests.llm.test_text_operators import BYTES, library, truth

BASE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    rows, steps = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, BASE).collect(), docs.schema)
        steps.append({r["doc_id"]: r for r in rows.collect()})
        assert rows.columns == docs.columns
    named, apart, cut, masked = steps
    assert len(named) >= 0.99 * docs.count()
    kept = truth([(i, r["text"]) for i, r in named.items()], 5)
    assert set(apart) == {i for i, (_, _, k) in kept.items() if k}
    assert set(cut) == set(masked) == set(apart)
    scanned = secret_scan.scan(spark.createDataFrame(list(masked.values()), docs.schema), secret_scan.train(spark), path="source")
    assert scanned.where(F.exists("findings", lambda f: f["secret"])).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, BASE).collect()
    by = collections.defaultdict(list)
    for p in packed:
        by[p["doc_id"]].append(p)
    full = library(BYTES)
    for i, r in masked.items():
        ids = [x for p in sorted(by[i], key=lambda p: p["start"]) for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert ids == full.encode(r["text"], add_special_tokens=False).ids + [0]


def test_odd_rows(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, BASE).columns == odd_docs.columns
        assert stage(spark, no_docs, BASE).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, BASE).count() == 0


def test_evidence_is_computed_once_for_each_row(spark, docs):
    """A filter on accepted rows takes no second copy of the Python function along: two would hold two workers for each task."""
    named = corpus_pipeline.identify_language(spark, docs, BASE)
    assert named._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, BASE).count() > 0
