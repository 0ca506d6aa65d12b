"""A rule engine for data quality: rules are columns, a row's violations an array, a batch's verdict an aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.functions.numbers import half_up
from tessera.operators.contracts import Contract

VIOLATION = "struct<rule_id:string,severity:string,field:string,message:string,value:string,outcome:string>"


@dataclass(frozen=True)
class Rule:
    """broken says when the rule is broken; outcome is quarantine or reject; BLOCK rules demote a row, others only mark it."""

    rule_id: str
    severity: str
    field: str | Column
    broken: Column = field(compare=False)
    message: str | Column = ""
    value: Column | None = field(default=None, compare=False)
    outcome: str | Column = "quarantine"
    domain: str = ""  # "" is every domain

    def violation(self) -> Column:
        said = lambda x: x if isinstance(x, Column) else F.lit(x)
        shown = self.value if self.value is not None else F.col(self.field)
        made = F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.severity).alias("severity"), said(self.field).alias("field"), said(self.message).alias("message"), F.left(shown.cast("string"), F.lit(200)).alias("value"), said(self.outcome).alias("outcome"))
        return F.when(F.coalesce(self.broken, F.lit(False)), made)


def rules_for(rules: list[Rule], domain: str) -> list[Rule]:
    """The rules that hold for a domain: its own and those of every domain."""
    return [r for r in rules if r.domain in ("", domain)]


def required(f: str) -> Rule:
    return Rule("DQ-SCHEMA-CONFORM", "BLOCK", f, F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), "required")


def conforms(contract: Contract) -> Rule:
    """The contract's first five problems, under the field of the first."""
    problems = contract.problems()
    shown = F.concat_ws("; ", F.slice(problems, 1, 5))
    return Rule("DQ-SCHEMA-CONFORM", "BLOCK", F.regexp_extract(F.try_element_at(problems, F.lit(1)), "^([^ :]*)", 1), F.size(problems) > 0, shown, F.lit(""))


# Columns that are put beside a source's own.
OWN_FIELDS = (
    "source", "source_id", "source_url", "authority", "authority_level", "license", "ingested_at", "quality", "run_id", "record_hash", "ingestion_method", "country", "crop", "crop_canonical",
    "crop_scientific_name", "state_code", "district_code", "agroclimatic_zone", "agroecological_region", "record_id", "query_id", "chunk_id", "farmer_language", "season", "month", "growth_stage",
    "expert_verified", "unit", "commodity_raw", "category", "subcategory", "answer_normalized",
)


def no_drift(contract: Contract, columns: list[str]) -> Rule:
    """Columns that neither the contract nor this engine knows, where a row has a value in them."""
    odd = [c for c in contract.unexpected(columns) if c not in OWN_FIELDS]
    found = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in odd])) if odd else F.array().cast("array<string>")
    listed = F.concat_ws(",", found)
    return Rule("DQ-SCHEMA-DRIFT", "WARN", listed, F.size(found) > 0, F.concat(F.lit("unexpected fields vs contract: "), listed), F.lit(""))


def date_parses(f: str, parsed: Column) -> Rule:
    return Rule("DQ-DATE-PARSE", "BLOCK", f, F.col(f).isNotNull() & parsed.isNull(), "not a date")


def not_future(f: str, day: Column, now: Column) -> Rule:
    return Rule("DQ-DATE-NOT-FUTURE", "BLOCK", f, day > F.date_add(now, 1), "in the future")


def price_triangle(low: str, modal: str, high: str) -> Rule:
    a, b, c = F.col(low), F.col(modal), F.col(high)
    negative = F.least(a, b, c) <= 0
    return Rule("DQ-PRICE-TRIANGLE", "BLOCK", modal, negative | (a > b) | (b > c) | (a > c), "prices out of order", F.concat_ws("/", a.cast("string"), b.cast("string"), c.cast("string")))


def far_from_median(f: str, median: str, mad: str, times: float = 5.0) -> Rule:
    return Rule("DQ-PRICE-OUTLIER-MAD", "WARN", f, (F.col(mad) > 0) & (F.abs(F.col(f) - F.col(median)) / F.col(mad) > times), "far from the median")


def resolved(rule_id: str, severity: str, f: str, found: str) -> Rule:
    return Rule(rule_id, severity, f, F.col(f).isNotNull() & F.col(found).isNull(), "not resolved")


def known_member(rule_id: str, severity: str, f: str, known: Column) -> Rule:
    return Rule(rule_id, severity, f, F.col(f).isNotNull() & ~known, "not in the register")


def web_address(f: str) -> Rule:
    return Rule("DQ-SOURCE-URL", "BLOCK", f, F.col(f).isNull() | ~F.col(f).rlike("^https?://"), "missing or not an http address")


# Parts of licences that may be kept, and of those that someone has to look at.
KEPT_LICENCES, REVIEWED_LICENCES = ("godl-india", "cc0", "cc-by", "public-domain", "open"), ("institutional", "unknown")


def licence_text(x: Column, kind: str = "string") -> Column:
    """Lower case and trimmed; of a struct its type, else its name."""
    said = F.coalesce(F.nullif(x["type"], F.lit("")), x["name"]) if kind == "struct" else x
    return F.lower(F.trim(F.coalesce(said.cast("string"), F.lit(""))))


def licence_allowed(f: str, kind: str = "string") -> Rule:
    """None and those to be reviewed are quarantined, those that aren't known rejected."""
    said = licence_text(F.col(f), kind)
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(said, p))
    return Rule("DQ-LICENSE-ALLOW", "BLOCK", f, ~has(KEPT_LICENCES), "licence not allowed", said, F.when((said == "") | has(REVIEWED_LICENCES), "quarantine").otherwise("reject"))


# The columns of free text, in the order they are joined.
TEXT_FIELDS = ("query_original", "answer_original", "answer_normalized", "query_en", "text", "recommendation")


def free_text(columns: list[str]) -> Column:
    """The columns of free text that a table has, joined by line breaks."""
    return F.concat_ws("\n", *[F.col(c) for c in TEXT_FIELDS if c in columns])


def live_method(f: str, live_only: bool = True) -> Rule:
    return Rule("DQ-INGEST-METHOD", "BLOCK", f, F.lit(live_only) & (F.col(f) == "fixture"), "not live", None, "reject")


def contact_details(f: str) -> Rule:
    kinds = T.pii_kinds(F.col(f), T.CONTACTS)
    return Rule("DQ-PII-REDACT", "WARN", f, F.size(kinds) > 0, "contact details", F.concat_ws(",", kinds))


def identifiers(f: str) -> Rule:
    kinds = T.pii_kinds(F.col(f), T.IDENTIFIERS)
    return Rule("DQ-PII-IDENTIFIER", "BLOCK", f, F.size(kinds) > 0, "personal identifiers", F.concat_ws(",", kinds), "reject")


def within(rule_id: str, severity: str, f: str, low: float, high: float) -> Rule:
    return Rule(rule_id, severity, f, (F.col(f) < low) | (F.col(f) > high), f"outside {low:g} to {high:g}")


# What a soil test can show.
SOIL_RANGES = {"N": (0, 2000), "P": (0, 500), "K": (0, 2000), "S": (0, 200), "Zn": (0, 50), "Fe": (0, 200), "Cu": (0, 50), "Mn": (0, 100), "B": (0, 20), "EC": (0, 10), "OC": (0, 5)}


def soil_ranges(columns: dict[str, str]) -> Rule:
    """Tests (their names by column) beyond what is plausible."""
    out = F.array_compact(F.array(*[F.when((F.col(c) < SOIL_RANGES[t][0]) | (F.col(c) > SOIL_RANGES[t][1]), F.concat(F.lit(f"{t}="), F.col(c).cast("string"))) for c, t in columns.items()]))
    return Rule("DQ-SOIL-RANGE", "BLOCK", "soil_test", F.size(out) > 0, "outside the plausible range", F.concat_ws(",", out), domain="soil")


def readable(f: str) -> Rule:
    return Rule("DQ-MOJIBAKE", "BLOCK", f, T.mojibake(F.col(f)), "wrong encoding", F.left(F.col(f), F.lit(40)))


def language_agrees(f: str, declared: str) -> Rule:
    """Hindi and Marathi count as one, since they share their script."""
    found, told = T.script_language(F.col(f)), F.col(declared)
    same = found.eqNullSafe(told) | (F.coalesce(found.isin("hi", "mr"), F.lit(False)) & told.isin("hi", "mr"))
    return Rule("DQ-LANG-CONSISTENT", "WARN", f, (F.trim(F.col(f)) != "") & (told != "") & ~same, "another language than declared", told)


def in_calendar(f: str, month: Column, allowed: Column) -> Rule:
    return Rule("DQ-CALENDAR-CONSISTENT", "WARN", f, F.size(allowed).isNotNull() & (F.size(allowed) > 0) & ~F.array_contains(allowed, month), "out of season")


def judge(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with violations and status: REJECT over QUARANTINE over PASS. One projection, no shuffle."""
    found = F.array_compact(F.array(*[r.violation() for r in rules])) if rules else F.array().cast(f"array<{VIOLATION}>")
    out = rows.withColumn("violations", found)
    rejected = F.exists("violations", lambda v: v["outcome"] == "reject")
    blocked = F.exists("violations", lambda v: (v["severity"] == "BLOCK") & (v["outcome"] == "quarantine"))
    return out.withColumn("status", F.when(rejected, "REJECT").when(blocked, "QUARANTINE").otherwise("PASS"))


def with_batch_rule(judged: DataFrame, broken: Column, rule_id: str, severity: str, name: str, message: str) -> DataFrame:
    """Adds a violation that only the whole batch shows, and demotes what passed until then if it blocks."""
    v = F.array(F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(name).alias("field"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("value"), F.lit("quarantine").alias("outcome")))
    hit = F.coalesce(broken, F.lit(False))
    out = judged.withColumn("violations", F.when(hit, F.concat("violations", v)).otherwise(F.col("violations")))
    return out.withColumn("status", F.when(hit & (F.col("status") == "PASS") & F.lit(severity == "BLOCK"), "QUARANTINE").otherwise(F.col("status")))


def unique_key(judged: DataFrame, key: list[str], hash_: str) -> DataFrame:
    """Blocks rows whose key, all parts given, has another content too."""
    w = Window.partitionBy(*key)
    given = F.lit(True)
    for k in key:
        given = given & F.col(k).isNotNull()
    marked = judged.withColumn("lo_", F.min(hash_).over(w)).withColumn("hi_", F.max(hash_).over(w))
    return with_batch_rule(marked, given & (F.col("lo_") != F.col("hi_")), "DQ-BUSINESS-KEY-UNIQUE", "BLOCK", ",".join(key), "several contents under one key").drop("lo_", "hi_")


def rule_counts(judged: DataFrame) -> DataFrame:
    v = judged.select(F.explode("violations").alias("v")).select("v.*")
    return v.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def scorecard(judged: DataFrame) -> DataFrame:
    """rows, passed, quarantined, rejected, block_count, warn_rate (of passed rows, 4 places)."""
    warned = F.exists("violations", lambda v: v["severity"] == "WARN") & (F.col("status") == "PASS")
    blocks = F.size(F.filter("violations", lambda v: v["severity"] == "BLOCK"))
    s = F.col("status")
    out = judged.agg(F.count("*").alias("n_rows"), F.count_if(s == "PASS").alias("passed"), F.count_if(s == "QUARANTINE").alias("quarantined"), F.count_if(s == "REJECT").alias("rejected"), F.coalesce(F.sum(blocks), F.lit(0)).cast("long").alias("block_count"), F.count_if(warned).alias("warned"))
    return out.withColumn("warn_rate", F.coalesce(half_up(F.try_divide(F.col("warned").cast("double"), F.col("n_rows").cast("double")), 4), F.lit(0.0)))


def gate(card: DataFrame, most_warned: float = 0.02) -> DataFrame:
    return card.withColumn("promoted", (F.col("block_count") == 0) & (F.col("warn_rate") <= most_warned))


def volume_verdict(n: Column, history: Column, low: int | None = None, high: int | None = None) -> Column:
    """ok, WARN or BLOCK: against a declared band, else BLOCK beyond six deviations of the upper median of five runs or more with rows."""
    if low is not None and high is not None:
        return F.when((n < 0.5 * low) | (n > 2 * high), "BLOCK").when((n < low) | (n > high), "WARN").otherwise("ok")
    real = F.filter(history, lambda x: x > 0)
    upper = lambda a: F.try_element_at(F.sort_array(a), (F.floor(F.size(a) / 2) + 1).cast("int"))
    middle = upper(real)
    spread = upper(F.transform(real, lambda x: F.abs(x - middle)))
    return F.when(F.size(real) < 5, "ok").when(F.abs(n - middle) > 6 * F.when(spread == 0, 1).otherwise(spread), "BLOCK").otherwise("ok")


def freshness_verdict(rows: DataFrame, days: list[Column], now: Column, most_days: int = 45) -> DataFrame:
    """One row: newest, age_days and verdict, WARN where the newest of all dates is older than so many days; ok without any."""
    newest = F.max(F.greatest(*days) if len(days) > 1 else days[0])
    age = F.datediff(now, F.col("newest"))
    return rows.agg(newest.alias("newest")).select("newest", age.alias("age_days"), F.when(age > most_days, "WARN").otherwise("ok").alias("verdict"))


# What each signal counts.
WEIGHTS = {"authority_score": 0.30, "freshness_score": 0.15, "completeness_score": 0.15, "location_specificity": 0.10, "crop_specificity": 0.10, "evidence_score": 0.10, "expert_verified": 0.05, "license_score": 0.05}


def quality_signals(*, authority: Column, published: Column, today: Column, required: list[Column], location: list[Column], crop: list[Column], evidence: list[Column], verified: Column, licence: Column) -> dict[str, Column]:
    """The eight signals of a record, each between 0 and 1."""
    given = lambda c: c.isNotNull() & (c.cast("string") != "")
    any_of = lambda cs: F.exists(F.array(*map(given, cs)), lambda x: x) if cs else F.lit(False)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = sum((one(given(c)) for c in required), F.lit(0.0)) / max(1, len(required))
    return {
        "authority_score": T.authority_score(authority), "freshness_score": D.freshness(published, today), "completeness_score": share,
        "location_specificity": one(any_of(location)), "crop_specificity": one(any_of(crop)), "evidence_score": one(any_of(evidence)),
        "expert_verified": one(F.coalesce(verified, F.lit(False))), "license_score": T.licence_score(licence),
    }


def quality_score(signals: dict[str, Column]) -> Column:
    """The weighted sum of the signals, 4 places."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + signals[name] * F.lit(weight)
    return half_up(total, 4)
