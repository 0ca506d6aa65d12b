"""Every row rule, and records put right, bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.operators import contracts, quality, refine
from tessera.plans.registry import query
from tessera.plans.texts import picked, picked_sql
from tessera.session import table

URLS = ("https://a.b/c", "", "ftp://x", "http://c", "HTTP://d")
LICENCES = ("CC-BY 4.0", "", "institutional", "my own", "Open data", "GODL-India", "Unknown")
METHODS = ("live", "fixture", "replay")
TEXTS = ("call 9876543210", "fine", "id 1234 5678 9012", "ABCDE1234F here", "write to a.b@c.org", "tomato Ã©tÃ©", "+91 8123456789 and x@y")
SAID = ("words", "टमाटर की फसल", "टोमॅटोच्या पानांवर", "ਕਣਕ", "   ")
LANGUAGES = ("en", "hi", "mr", "")
DAYS = ("2026-01-05", "05/02/2026", "no day", "", "2099-01-01")

RULES_SQL = f"""x as (select c_custkey k, c_acctbal bal, c_mktsegment seg, {picked_sql('c_custkey', URLS)} url, lower({picked_sql('c_custkey', LICENCES)}) lic, {picked_sql('c_custkey', METHODS)} method, {picked_sql('c_custkey', TEXTS)} text, {picked_sql('c_custkey', SAID)} said, {picked_sql('c_custkey', LANGUAGES)} lang, {picked_sql('c_custkey', DAYS)} d, c_custkey % 12 + 1 as month from customer),
y as (select *, case when d like '%/%' then d[7:10] || '-' || d[4:5] || '-' || d[1:2] when d like '2%' then d end::date dd, case when said = 'words' then 'en' when said = 'ਕਣਕ' then 'pa' when said like 'टमाटर%' then 'hi' when said like 'टोमॅटोच्या%' then 'mr' end found from x)
"""
#: (rule, severity, outcome, condition in SQL)
CONDITIONS = (
    ("DQ-SCHEMA-CONFORM", "BLOCK", "bal < 0 or bal > 9000 or seg not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')"),
    ("DQ-SCHEMA-DRIFT", "WARN", "k % 3 = 0"),
    ("DQ-DATE-PARSE", "BLOCK", "d <> '' and dd is null"),
    ("DQ-DATE-NOT-FUTURE", "BLOCK", "dd > date '2026-07-01' + 1"),
    ("DQ-PRICE-OUTLIER-MAD", "WARN", "abs(bal - 4000) / 800 > 5"),
    ("DQ-CROP-RESOLVED", "INFO", "k % 4 = 0"),
    ("DQ-MARKET-KNOWN", "INFO", "seg not in ('AUTOMOBILE', 'BUILDING')"),
    ("DQ-SOURCE-URL", "BLOCK", "url = '' or not regexp_matches(url, '^https?://')"),
    ("DQ-LICENSE-ALLOW", "BLOCK", "not (lic like '%godl-india%' or lic like '%cc0%' or lic like '%cc-by%' or lic like '%public-domain%' or lic like '%open%')"),
    ("DQ-INGEST-METHOD", "BLOCK", "method = 'fixture'"),
    ("DQ-PII-REDACT", "WARN", "regexp_matches(text, '(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)') or text like '%@%'"),
    ("DQ-PII-IDENTIFIER", "BLOCK", "regexp_matches(text, '[0-9]{4} [0-9]{4} [0-9]{4}') or text like 'ABCDE1234F%'"),
    ("DQ-SOIL-RANGE", "BLOCK", "k % 2500 > 2000 or k % 700 > 500"),
    ("DQ-MOJIBAKE", "BLOCK", "text like '%Ã©%'"),
    ("DQ-LANG-CONSISTENT", "WARN", "trim(said) <> '' and lang <> '' and found <> lang and not (found in ('hi', 'mr') and lang in ('hi', 'mr'))"),
    ("DQ-CALENDAR-CONSISTENT", "WARN", "seg = 'BUILDING' and month not in (3, 4, 5)"),
)


def _judged(spark, d):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    none = lambda c: F.nullif(c, F.lit(""))
    rows = table(spark, d, "customer").select(
        k.alias("k"), F.col("c_acctbal").alias("bal"), seg.alias("seg"), none(picked(k, URLS)).alias("url"), none(picked(k, LICENCES)).alias("lic"), picked(k, METHODS).alias("method"), picked(k, TEXTS).alias("text"),
        picked(k, SAID).alias("said"), picked(k, LANGUAGES).alias("lang"), none(picked(k, DAYS)).alias("day"), (k % 12 + 1).cast("int").alias("month"), F.when(k % 3 == 0, "odd").alias("extra"),
        F.when(k % 4 != 0, "x").alias("crop_id"), F.lit("x").alias("crop"), F.lit(4000.0).alias("median"), F.lit(800.0).alias("mad"), (k % 2500).cast("double").alias("n_"), (k % 700).cast("double").alias("p_"),
    )
    contract = contracts.Contract("rows", (contracts.Field("bal", "float", low=0, high=9000), contracts.Field("seg", one_of=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))))
    parsed = F.to_date(dates.parse(F.col("day")))
    return quality.judge(rows, [
        quality.conforms(contract), quality.no_drift(contract, ["bal", "seg", "extra", "crop"]), quality.date_parses("day", parsed), quality.not_future("day", parsed, F.lit("2026-07-01").cast("date")),
        quality.far_from_median("bal", "median", "mad"), quality.resolved("DQ-CROP-RESOLVED", "INFO", "crop", "crop_id"), quality.known_member("DQ-MARKET-KNOWN", "INFO", "seg", F.col("seg").isin("AUTOMOBILE", "BUILDING")),
        quality.web_address("url"), quality.licence_allowed("lic"), quality.live_method("method"), quality.contact_details("text"), quality.identifiers("text"), quality.soil_ranges({"n_": "N", "p_": "P"}), quality.readable("text"),
        quality.language_agrees("said", "lang"), quality.in_calendar("month", F.col("month"), F.when(F.col("seg") == "BUILDING", F.array(F.lit(3), F.lit(4), F.lit(5)))),
    ])


REJECTS = {"DQ-INGEST-METHOD": "true", "DQ-PII-IDENTIFIER": "true", "DQ-LICENSE-ALLOW": "not (lic = '' or lic like '%institutional%' or lic like '%unknown%')"}


@query("all_row_rules", f"with {RULES_SQL}, u as (" + " union all ".join(f"select '{r}' rule_id, '{s}' severity, count(*) n from y where {c}" for r, s, c in CONDITIONS) + ") select * from u where n > 0")
def all_row_rules(spark, d):
    """How often each row rule is broken, over rows that meet every branch."""
    return quality.rule_counts(_judged(spark, d))


@query("all_row_statuses", f"with {RULES_SQL}, j as (select k, {' or '.join(f'coalesce(({c}) and ({REJECTS[r]}), false)' for r, s, c in CONDITIONS if r in REJECTS)} rej, {' or '.join(f'coalesce({c}, false)' for r, s, c in CONDITIONS if s == 'BLOCK')} blk from y) select k, case when rej then 'REJECT' when blk then 'QUARANTINE' else 'PASS' end status from j")
def all_row_statuses(spark, d):
    return _judged(spark, d).select("k", "status")


@query("refined_records", f"""with x as (select c_custkey k, {picked_sql('c_custkey', DAYS)} d, {picked_sql('c_custkey', TEXTS)} t from customer) select k, case when d like '__/%' then d[7:10] || '-' || d[4:5] || '-' || d[1:2] else nullif(d, '') end as day, case when d like '__/%' then d end day_raw, d = 'no day' problem,
regexp_replace(regexp_replace(regexp_replace(t, '(\\+91 )?[6-9][0-9]{{9}}', '[redacted]', 'g'), '[a-z.]+@[a-z]+\\.[a-z.]+', '[redacted]', 'g'), '^$', '') as text, array_to_string(list_filter([case when t like '%1234 5678%' then 'aadhaar' end, case when t like '%@%.%' then 'email' end, case when t like 'ABCDE%' then 'pan' end, case when regexp_matches(t, '[6-9][0-9]{{9}}') then 'phone' end], lambda v: v is not null), ',') kinds from x""")
def refined_records(spark, d):
    """Days as ISO text with what they were, and contact details masked."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), F.nullif(picked(k, DAYS), F.lit("")).alias("day"), picked(k, TEXTS).alias("text"))
    got = refine.refined(rows, {"day": None})
    return got.select("k", "day", "day_raw", (F.size("problems") > 0).alias("problem"), "text", F.concat_ws(",", "pii_kinds").alias("kinds"))


@query("converted_prices", """with x as (select p_partkey k, p_retailprice p, ['INR/quintal', 'Rs/Tonne', 'kg', ''][p_partkey % 4 + 1] u from part) select k, case when u = 'Rs/Tonne' then floor(p / 10 * 100 + 0.5) / 100 else p end modal_price, case when u in ('Rs/Tonne', '') then 'INR/quintal' else u end unit from x""")
def converted_prices(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), F.col("p_retailprice").alias("modal_price"), F.nullif(picked(k, ("INR/quintal", "Rs/Tonne", "kg", "")), F.lit("")).alias("unit"))
    return refine.priced_in(rows)


@query("host_crops", """with h as (select p_partkey, unnest([split_part(p_name, ' ', 1), lower(p_type), 'the ' || split_part(p_name, ' ', 2)]) h from part), c as (select distinct split_part(p_name, ' ', 2) c from part union select 'economy class') select distinct p_partkey pest_id, c crop_id from h join c on contains(h, c) or contains(c, h)""")
def host_crops(spark, d):
    p = table(spark, d, "part")
    pests = p.select(F.col("p_partkey").alias("pest_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("; "), "p_type", F.lit(" / the "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("hosts"))
    crops = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct().union(p.sparkSession.createDataFrame([("economy class",)], "name string"))
    return refine.host_crops(pests, crops.withColumn("crop_id", F.col("name")))


@query("symptom_terms", """with c as (select item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda t: len(t) >= 3 and t not in ("""
    + ", ".join(f"'{w}'" for w in T.SYMPTOM_STOP_WORDS)
    + """)) w from benchmark) select item_id, t, count(*) n from (select distinct item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) t from c) group by all""")
def symptom_terms(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.explode(T.symptom_tokens(F.col("text"))).alias("t"))
    return b.groupBy("item_id", "t").agg(F.count("*").alias("n"))
