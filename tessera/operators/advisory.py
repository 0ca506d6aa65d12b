"""Advice from rule tables: nutrient doses, calendars, diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.functions.numbers import half_up


def doses(need: DataFrame, n: str, p: str, k: str) -> DataFrame:
    """Products for needs of nitrogen, phosphate and potash: phosphate by DAP first, whose nitrogen counts, then urea and MOP."""
    dap = F.col(p) / 0.46
    rest = F.greatest(F.col(n) - 0.18 * dap, F.lit(0.0))
    return need.withColumns({"dap": half_up(dap, 1), "urea": half_up(rest / 0.46, 1), "mop": half_up(F.col(k) / 0.6, 1)})


def adjusted(total: Column, status: Column, step: Column) -> Column:
    """More where the soil is low, less where it is high."""
    return half_up(F.when(status == "low", total * (1 + step)).when(status == "high", total * (1 - step)).otherwise(total), 2)


def by_timing(plan: DataFrame, keys: list[str], total: str, shares: dict[str, str]) -> DataFrame:
    """One row for each timing with a share: (keys, timing, kg)."""
    long = plan.select(*keys, total, *shares.values()).unpivot([*keys, total], list(shares.values()), "timing_column", "share")
    names = F.create_map(*[F.lit(v) for t, c in shares.items() for v in (c, t)])
    return long.where("share > 0").select(*keys, names[F.col("timing_column")].alias("timing"), half_up(F.col(total) * F.col("share"), 2).alias("kg"))


def windows(calendar: DataFrame, keys: list[str], start: str, end: str, stage: str) -> DataFrame:
    """By key: months of sowing, of harvest, and of anything, sorted by their distance from June."""
    each = calendar.select(*keys, F.col(stage).alias("stage"), F.explode(dates.months(F.col(start), F.col(end))).alias("month"))
    set_of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("month"))), lambda a, b: F.pmod(a - 6, F.lit(12)) - F.pmod(b - 6, F.lit(12)))
    return each.groupBy(*keys).agg(set_of(F.col("stage") == "sowing").alias("sow"), set_of(F.col("stage").isin("harvest", "maturity")).alias("harvest"), F.countDistinct("month").alias("duration"))


# What each kind of entity is worth, and what a word, the crop and the stage add.
AUTHORITY = {"disease": 1.0, "deficiency": 0.95, "pest": 0.9}
PER_WORD, FOR_CROP, FOR_STAGE = 2.0, 3.0, 1.0
#: Words of cases that one pass over the entities looks for; more take further passes.
WORDS_A_PASS = 50_000


def _parts_found(entities: DataFrame, words: list[str]) -> DataFrame:
    """(entity, t): which words are part of an entity's symptom text. One automaton finds all of them in one pass over each text."""
    kind = entities.schema["entity"].dataType.simpleString()
    shared = entities.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("plain").to_pylist()):
                hits = {w for _, w in automaton.iter(text)}
                row += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column("entity").take(pa.array(row, pa.int64())), pa.array(found, pa.string())], ["entity", "t"])

    plain = entities.select("entity", F.coalesce(T.symptom_text(F.col("text")), F.lit("")).alias("plain"))
    return plain.mapInArrow(work, f"entity {kind}, t string")


def diagnose(cases: DataFrame, entities: DataFrame, *, case_id: str, symptoms: str, crop: str, stage: str | None = None, top: int = 5, strict: bool = True, lexicon: dict | None = None) -> DataFrame:
    """(case_id, entity, score, matched, rank): entities (entity, kind, crop, text and, if there is one, stage: a list with |) that fit a case's symptoms.

    A token of the symptoms fits by the stem of a word of the text, in an equi-join, or as a part of the text. With a crop
    given, an entity must be of that crop, or, if not strict, fit three tokens. Score: authority of its kind times
    (2 for each token + 3 for the crop), + 1 if the reported stage is among its own.
    """
    wanted = cases.select(case_id, F.lower(F.trim(crop)).alias("case_crop"), (F.col(stage) if stage else F.lit(None).cast("string")).alias("case_stage"), F.explode(T.symptom_tokens(F.col(symptoms), lexicon)).alias("t"))
    own = entities.select("entity", F.explode(F.array_distinct(F.transform(F.filter(F.split(T.symptom_text(F.col("text")), "[^a-z0-9]+"), lambda w: w != ""), T.stem))).alias("s"))
    distinct = wanted.select("t").distinct()
    words = sorted(r["t"] for r in distinct.collect())  # those of a set of queries, not of the entities
    found = distinct.select("t", T.stem(F.col("t")).alias("s")).join(own, "s").select("entity", "t")
    for at in range(0, len(words), WORDS_A_PASS):
        found = found.union(_parts_found(entities, words[at : at + WORDS_A_PASS]))
    hits = found.distinct().join(wanted, "t").groupBy(case_id, "entity").agg(F.count("*").alias("matched"), F.first("case_crop").alias("case_crop"), F.first("case_stage").alias("case_stage"))
    about = entities.select("entity", "kind", F.lower(F.trim("crop")).alias("entity_crop"), (F.col("stage") if "stage" in entities.columns else F.lit(None).cast("string")).alias("entity_stage"))
    both = hits.join(about, "entity")
    given = F.coalesce(F.col("case_crop") != "", F.lit(False))
    same = given & F.coalesce(F.col("case_crop") == F.col("entity_crop"), F.lit(False))
    fits = ~given | same | (F.lit(not strict) & (F.col("matched") >= 3))
    authority = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])[F.col("kind")]
    bonus = F.when(F.array_contains(F.split("entity_stage", r"\|"), F.col("case_stage")), FOR_STAGE).otherwise(0.0)
    scored = both.where(fits).withColumn("score", half_up(F.coalesce(authority, F.lit(1.0)) * (PER_WORD * F.col("matched") + F.when(same, FOR_CROP).otherwise(0.0)) + bonus, 4))
    order = Window.partitionBy(case_id).orderBy(F.desc("score"), "entity")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(case_id, "entity", "score", "matched", "rank")


# The first part of a forecast's words that is found, in this order, gives the rain in mm a day.
RAIN = (("very heavy", 120.0), ("heavy", 80.0), ("moderate", 25.0), ("scattered", 8.0), ("light", 5.0), ("drizzle", 2.0), ("dry", 0.0), ("no rain", 0.0))


def rain_of(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0.0)
    for part, mm in reversed(RAIN):
        out = F.when(F.contains(lower, F.lit(part)), mm).otherwise(out)
    return out
