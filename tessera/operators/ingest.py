"""One run over a batch from a source: stamp, split, judge, decide, and what each table gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import dedupe, quality
from tessera.sources import lake, tables
from tessera.sources.shared import kept


@dataclass
class Run:
    """What a run leaves. Only `published` may reach gold: rows that pass, of a run that is promoted."""

    judged: DataFrame
    card: DataFrame
    published: DataFrame
    quarantine: DataFrame
    violations: DataFrame
    marks: DataFrame
    ledger: DataFrame


def run_batch(rows: DataFrame, *, run_id: str, method: str, key: list[str], order: list[Column | str], rules: list[quality.Rule], marks: DataFrame, mark_key: list[str], mark_value: str, most_warned: float = 0.02, now: Column | None = None) -> Run:
    """rows beyond the marks are stamped with provenance and a hash, repeats go, conflicts and rules demote, and the gate decides.

    Everything is lazy; the shuffles are the split by key and the aggregates of the card and the marks.
    """
    fresh = tables.past_marks(rows, marks, mark_key, mark_value)
    stamped = tables.stamped(fresh, run_id, method, dedupe.record_hash(rows.columns))
    split = dedupe.split_three(stamped, key, "record_hash", order).where("kind <> 'duplicate'")
    judged = quality.judge(split, rules)
    judged = quality.with_batch_rule(judged, F.col("kind") == "conflict", "DQ-BUSINESS-KEY-UNIQUE", "BLOCK", ",".join(key), "another content under the same key")
    card = quality.gate(quality.scorecard(judged), most_warned).withColumn("run_id", F.lit(run_id))
    promoted = card.select("promoted").scalar()
    passed = judged.where("status = 'PASS'").drop("violations", "status", "kind")
    violations = judged.select(F.lit(run_id).alias("run_id"), "record_hash", F.explode("violations").alias("v")).select("run_id", "record_hash", "v.*")
    ledger = card.select("run_id", F.lit(method).alias("method"), (now if now is not None else F.current_timestamp()).alias("finished_at"), "n_rows", "passed", "quarantined", "rejected", "promoted")
    return Run(judged, card, passed.where(promoted), judged.where("status <> 'PASS'"), violations, tables.advance(marks, passed, mark_key, mark_value), ledger)


def persisted(run: Run, root: str, run_id: str) -> dict[str, int]:
    """Writes what a run leaves, and says how many rows went where: gold gets the published rows, the others are audits.

    The judged rows are kept first, so everything comes from one reading of the source. A run that is written again takes its own
    place; marks are replaced last, so a run that dies before is simply run again.
    """
    judged = kept(run.judged, "judged")
    card = kept(quality.gate(quality.scorecard(judged)).withColumn("run_id", F.lit(run_id)), "card")
    promoted = bool(card.first()["promoted"])
    gold = judged.where(F.lit(promoted) & (F.col("status") == "PASS")).drop("violations", "status", "kind")
    violations = judged.select("record_hash", F.explode("violations").alias("v")).select("record_hash", "v.*")
    tables_ = {"gold": gold, "quarantine": judged.where("status <> 'PASS'"), "dq_violation": violations, "dq_scorecard": card, "ingest_run": run.ledger}
    for name, rows in tables_.items():
        lake.append_audit(rows, f"{root}/{name}", run_id)
    marks = lake.replace_folder(run.marks.drop("advanced"), f"{root}/ingest_watermark")
    spark = judged.sparkSession
    counts = {name: spark.read.parquet(f"{root}/{name}").where(F.col("run_id") == run_id).count() if _any(spark, f"{root}/{name}") else 0 for name in tables_}
    return {**counts, "ingest_watermark": marks.count()}


def _any(spark, path: str) -> bool:
    found = lake.readable(spark, path)
    return found is not None and "run_id" in found.columns
