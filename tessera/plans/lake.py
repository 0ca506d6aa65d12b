"""Silver maps, the layers of the lake, and advice end to end, bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.operators import farm, quality, silver
from tessera.plans.registry import query
from tessera.plans.texts import picked, picked_sql
from tessera.session import table
from tessera.sources import lake
from tessera.sources.shared import shared_folder

DAYS = ("05/02/2026", "2026-01-15", "n.d.", "", "17-03-2026")
PRICES = ("1,250.50", "NR", "900", "", "12,34,567.8")


@query("silver_market_prices", f"""with r as (select p_partkey k, p_partkey % 25 n, p_type t, {picked_sql('p_partkey', DAYS)} d, {picked_sql('p_partkey', PRICES)} p, p_retailprice rp, p_size z, p_brand b from part),
x as (select *, case when d like '%/%/%' then d[7:10] || '-' || d[4:5] || '-' || d[1:2] when d like '%-%-2026' then d[7:10] || '-' || d[4:5] || '-' || d[1:2] when d = '' then null else d end iso, case when k % 3 = 0 then 'C-' || t when k % 3 = 1 then 'C-' || t end crop from r)
select 'AMN-' || case when k % 11 = 0 then 'na' else lower(regexp_replace(regexp_replace(b || ' Yard!', '[^a-zA-Z0-9._-]+', '_', 'g'), '_$', '')) end || '-' || case when k % 3 = 2 then 'something_else' when k % 3 = 1 then 'local_' || lower(t) else lower(t) end || '-' || coalesce(iso, 'nodate') record_id,
crop, case when crop is not null then lower(t) end crop_canonical, 'S' || n state_code, case when z % 4 = 0 then 'D' || n end district_code, try_cast(nullif(replace(p, ',', ''), '') as double) min_price, rp modal_price, iso price_date, case when d <> iso then d end price_date_raw from x""")
def silver_market_prices(spark, d):
    """A feed whose columns come under other names, with prices and days written in several ways, as canonical records."""
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.concat(F.lit("Local "), F.lower("p_type"))).otherwise("something else")
    raw = table(spark, d, "part").select(
        F.concat(F.lit(" nation_"), k % 25).alias("State"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Town "), k % 25)).alias("district"), F.when(k % 11 != 0, F.concat("p_brand", F.lit(" Yard!"))).alias("APMC"),
        said.alias("Commodity"), picked(k, PRICES).alias("Min_x0020_Price"), F.lit("").alias("Modal Price (Rs./Quintal)"), F.col("p_retailprice").alias("modal_price"), picked(k, DAYS).alias("Price Date"),
    )
    types = table(spark, d, "part").select("p_type").distinct()
    crops = types.select(F.col("p_type").alias("key"), F.concat(F.lit("C-"), "p_type").alias("target"), F.lit(1).alias("priority"), F.lit(1).alias("ord"))
    crops = crops.unionByName(types.where("p_type <> 'PROMO'").select(F.concat(F.lit("LOCAL-"), "p_type").alias("key"), F.concat(F.lit("C-"), "p_type").alias("target"), F.lit(2).alias("priority"), F.lit(1).alias("ord")))
    about = types.select(F.concat(F.lit("C-"), "p_type").alias("crop_id"), F.lower("p_type").alias("canonical_en"), F.lit(None).cast("string").alias("scientific_name"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("state"), F.concat(F.lit("Town "), "n_nationkey").alias("district"), F.concat(F.lit("S"), "n_nationkey").alias("state_code"), F.concat(F.lit("D"), "n_nationkey").alias("district_code"), F.lit("z").alias("agroclimatic_zone"))
    out = silver.market_prices(raw, crops.where("key <> 'LOCAL-PROMO'"), about, n)
    return out.select("record_id", "crop", "crop_canonical", "state_code", "district_code", "min_price", "modal_price", "price_date", "price_date_raw")


@query("silver_questions", """with d as (select conv_id, turn, text, conv_id % 4 k from conversations)
select 'KCC-' || case when k = 0 then 'XX' else 'NATION_' || k end || '-XX-' || case when k = 1 then '' else '2026-0' || (conv_id % 9 + 1) end || '-' || conv_id || '.' || turn query_id, sha256(trim(text)) h, case when k <> 1 then conv_id % 9 + 1 end::int as month, case k when 0 then 'kharif' when 1 then 'whole_year' when 2 then 'rabi' end season, case when k < 2 then 'plants' else 'animals' end category, case when k > 0 then 'S' || k end state_code from d""")
def silver_questions(spark, d):
    c = F.col("conv_id")
    k = c % 4
    raw = table(spark, d, "conversations").select(
        F.when(k > 0, F.concat(F.lit("NATION_"), k)).alias("StateName"), F.col("text").alias("QueryText"), F.lit("").alias("KCCAnswer"), picked(k, ("KHARIF 2026", "whole year", "late rabi", "none")).alias("season"),
        F.when(k < 2, "AGRICULTURE").otherwise("animals").alias("Sector"), F.when(k != 1, F.concat(F.lit("2026-0"), c % 9 + 1, F.lit("-11T10:00:00"))).alias("CreatedOn"), F.concat(c, F.lit("."), "turn").alias("_id"), F.lit(None).cast("string").alias("Crop"),
    )
    n = table(spark, d, "nation").select(F.col("n_name").alias("state"), F.lit("").alias("district"), F.concat(F.lit("S"), "n_nationkey").alias("state_code"), F.lit(None).cast("string").alias("district_code"), F.lit(None).cast("string").alias("agroclimatic_zone"))
    crops = spark.createDataFrame([("x", "X", 1, 1)], "key string, target string, priority int, ord int")
    about = spark.createDataFrame([("X", "x", None)], "crop_id string, canonical_en string, scientific_name string")
    return silver.questions(raw, crops, about, n, {"agriculture": "plants"}).select("query_id", F.sha2("query_original", 256).alias("h"), "month", "season", "category", "state_code")


@query("page_chunks", """with t as (select url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b.*?</nav\\s*>', ' ', 'g'), '(?is)<header\\b.*?</header\\s*>', ' ', 'g'), '(?is)<footer\\b.*?</footer\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) w from pages),
p as (select url, w, trim(unnest(list_transform(range(0, (len(w) - 1) // 1000 + 1), lambda i: substr(w, i * 1000 + 1, 1000)))) piece from t where len(w) > 0) select url source_url, left(sha256(piece), 16) chunk_id, sha256(w) content_hash from p where piece <> ''""")
def page_chunks(spark, d):
    made = silver.article_chunks(table(spark, d, "pages"), "url", "html", F.lit("CC-BY"), F.lit("open"), F.lit("2026-01-01"))
    return made.select("source_url", "chunk_id", "content_hash")


@query("medallion", """with b as (select html from pages union select html || '!' from pages where page_id % 2 = 0) select 'bronze' layer, 'first' name, count(distinct html) n from pages union all select 'bronze', 'again', 0 union all select 'bronze', 'changed', (select count(distinct html || '!') from pages where page_id % 2 = 0)
union all select 'manifest', 'all', (select count(distinct html) from pages) + (select count(distinct html || '!') from pages where page_id % 2 = 0) union all select 'silver', 'passed', (select count(*) from part where p_size > 5) union all select 'gold', 'fact', (select count(*) from part where p_size > 5) union all select 'gold', 'score', (select cast(sum(round(0.30 * 1 + 0.15 * 0.5 + 0.15 + 0.10 + 0.10 + 0.10 * 0 + 0.05, 4) * 10000) as bigint) from part where p_size > 5) union all select 'rebuild', 'first', 1 union all select 'rebuild', 'again', 0 union all select 'rebuild', 'changed', 1""")
def medallion(spark, d):
    """Raw pages stored by content, three times; part records judged into silver; gold made from what passed, and again only if that changed."""
    root = shared_folder(spark, "lake")
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("resource_id"), F.concat("page_id", F.lit(".html")).alias("filename"), F.col("html").alias("payload"), F.lit("{}").alias("meta"))
    pages = pages.groupBy("payload").agg(F.min(F.struct("resource_id", "filename", "meta")).alias("r")).select("r.*", "payload")
    changed = table(spark, d, "pages").where("page_id % 2 = 0").select(F.concat("html", F.lit("!")).alias("payload")).distinct().select(F.sha2("payload", 256).alias("resource_id"), F.lit("x").alias("filename"), F.lit("{}").alias("meta"), "payload")
    counts = [("bronze", name, lake.write_bronze(rows, f"{root}/bronze", source="web").count()) for name, rows in (("first", pages), ("again", pages), ("changed", changed))]
    counts.append(("manifest", "all", spark.read.parquet(f"{root}/bronze/manifest").count()))

    records = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("crop"), F.col("p_brand").alias("state"), F.col("p_size").alias("value"))
    judged = quality.judge(records, [quality.within("DQ-RANGE", "BLOCK", "value", 6, 1e9)])
    passed = lake.silver(judged.where("status = 'PASS'").drop("violations", "status"), run_id="r1", method="live", source="parts", licence="GODL-India", authority="government", today=F.lit("2026-01-01").cast("date"))
    stored = lake.replace_folder(passed, f"{root}/silver/parts")
    counts.append(("silver", "passed", stored.count()))
    for name, rows in (("first", stored), ("again", stored), ("changed", stored.where("value > 10"))):
        ran = lake.rebuilt(spark, f"{root}/state", "fact", [rows], lambda: lake.gold(stored, f"{root}/gold", "fact"))
        counts.append(("rebuild", name, int(ran)))
    fact = spark.read.parquet(f"{root}/gold/fact")
    counts.append(("gold", "fact", fact.count()))
    score = fact.agg(F.sum(F.round(F.col("quality.quality_score") * 10000)).cast("long")).first()[0]
    return spark.createDataFrame([*counts, ("gold", "score", score)], "layer string, name string, n long")


STAGES = ("STAGE_NURSERY", "STAGE_SOWING", "STAGE_VEGETATIVE", "STAGE_TRANSPLANTING", "STAGE_MATURITY", "STAGE_HARVEST")
CALENDAR = f"""base as (select p_brand crop_id, 'SEASON_' || (p_size % 3) season_id, {picked_sql('p_partkey', STAGES)} stage_id, p_size % 12 + 1 month_start, (p_size + p_partkey % 4) % 12 + 1 month_end, p_partkey ord from part),
over as (select 'Brand#' || (s_suppkey % 25 + 1) crop_id, 'SEASON_' || (s_suppkey % 3) season_id, {picked_sql('s_suppkey', STAGES)} stage_id, s_suppkey % 12 + 1 month_start, s_suppkey % 12 + 1 month_end, 1000000000 + s_suppkey ord, 'S' || s_nationkey state_code, case when s_suppkey % 2 = 0 then 'D' || (s_suppkey % 10) else '' end district_code from supplier),
req as (select c_custkey id, 'Brand#' || (c_custkey % 27 + 1) crop_id, 'S' || c_nationkey state_code, 'D' || (c_custkey % 10) district_code, c_custkey % 12 + 1 as month from customer)"""
LOCATED = CALENDAR + """, hold as (select id, b.*, 0 lv from req join base b using (crop_id) union all by name select id, o.* exclude (state_code, district_code), 1 lv from req join over o on o.crop_id = req.crop_id and o.state_code = req.state_code and o.district_code = '' union all by name select id, o.* exclude (state_code, district_code), 2 lv from req join over o on o.crop_id = req.crop_id and o.district_code = req.district_code and o.district_code <> ''),
top as (select *, min((lv > 0, ord)) over (partition by id, crop_id, season_id, stage_id) place from hold qualify row_number() over (partition by id, crop_id, season_id, stage_id order by lv desc, ord desc) = 1),
mon as (select *, list_transform(range(0, ((month_end - month_start + 12) % 12) + 1), lambda i: (month_start - 1 + i) % 12 + 1) as months from top)"""


def _calendar(spark, d):
    p, s, c = (table(spark, d, t) for t in ("part", "supplier", "customer"))
    z, k = F.col("p_size"), F.col("p_partkey")
    base = p.select(F.col("p_brand").alias("crop_id"), F.concat(F.lit("SEASON_"), z % 3).alias("season_id"), picked(k, STAGES).alias("stage_id"), (z % 12 + 1).cast("int").alias("month_start"), ((z + k % 4) % 12 + 1).cast("int").alias("month_end"), F.lit(None).cast("string").alias("note"), k.alias("ord"))
    n = F.col("s_suppkey")
    over = s.select(F.concat(F.lit("Brand#"), n % 25 + 1).alias("crop_id"), F.concat(F.lit("SEASON_"), n % 3).alias("season_id"), picked(n, STAGES).alias("stage_id"), (n % 12 + 1).cast("int").alias("month_start"), (n % 12 + 1).cast("int").alias("month_end"), F.lit(None).cast("string").alias("note"), (n + 1_000_000_000).alias("ord"), F.concat(F.lit("S"), "s_nationkey").alias("state_code"), F.when(n % 2 == 0, F.concat(F.lit("D"), n % 10)).otherwise("").alias("district_code"))
    i = F.col("c_custkey")
    asked = c.select(i.alias("id"), F.concat(F.lit("Brand#"), i % 27 + 1).alias("crop_id"), F.concat(F.lit("S"), "c_nationkey").alias("state_code"), F.concat(F.lit("D"), i % 10).alias("district_code"), (i % 12 + 1).cast("int").alias("month"))
    stages = spark.createDataFrame([(x, x.removeprefix("STAGE_").title()) for x in STAGES], "stage_id string, name string")
    seasons = spark.createDataFrame([(f"SEASON_{j}", f"Season {j}") for j in range(3)], "season_id string, name string")
    return asked, base, over, stages, seasons


@query("crop_plans", f"""with {LOCATED}, s as (select id, crop_id, flatten(list(months order by season_id, month_start, place) filter (where stage_id in ('STAGE_SOWING', 'STAGE_NURSERY', 'STAGE_TRANSPLANTING'))) sow, flatten(list(months order by season_id, month_start, place) filter (where stage_id in ('STAGE_HARVEST', 'STAGE_MATURITY'))) reap, len(list_distinct(flatten(list(months))))::int duration_months, count(*)::int stages, count(distinct season_id)::int seasons from mon group by id, crop_id)
select id, crop_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(coalesce(sow, [])), lambda m: (m + 6) % 12)), lambda a: (a + 5) % 12 + 1), ',') sow, array_to_string(list_filter(coalesce(reap, []), lambda m, i: list_position(reap, m) = i), ',') harvest, duration_months, stages, seasons from s""")
def crop_plans(spark, d):
    """A plan for each customer's crop at its place: the calendar with what state and district say otherwise."""
    asked, base, over, stages, seasons = _calendar(spark, d)
    got = farm.crop_plans(asked, base, over, stages, seasons)
    return got.select("id", "crop_id", F.concat_ws(",", F.transform("sow_window", lambda m: m.cast("string"))).alias("sow"), F.concat_ws(",", F.transform("harvest_window", lambda m: m.cast("string"))).alias("harvest"), "duration_months", F.size("timeline").alias("stages"), F.size("seasons").alias("seasons"))


@query("crops_to_sow", "with " + CALENDAR + """, b as (select * from base qualify row_number() over (partition by crop_id, season_id, stage_id order by ord desc) = 1), bp as (select crop_id, season_id, stage_id, min(ord) o from base group by all),
hit as (select id, o.* from req join over o on (o.state_code = req.state_code and o.district_code = '') or (o.district_code = req.district_code and o.district_code <> '')), ov as (select *, min(ord) over (partition by id, crop_id, season_id, stage_id) o from hit qualify row_number() over (partition by id, crop_id, season_id, stage_id order by district_code <> '' desc, ord desc) = 1),
cal as (select req.id, b.crop_id, b.season_id, b.stage_id, b.month_start, b.month_end, false later, bp.o from req cross join b join bp on bp.crop_id = b.crop_id and bp.season_id = b.season_id and bp.stage_id = b.stage_id where not exists (select 1 from ov where ov.id = req.id and ov.crop_id = b.crop_id and ov.season_id = b.season_id and ov.stage_id = b.stage_id) union all select id, crop_id, season_id, stage_id, month_start, month_end, true, o from ov),
m as (select cal.*, list_transform(range(0, ((month_end - month_start + 12) % 12) + 1), lambda i: (month_start - 1 + i) % 12 + 1) as months, req.month as wanted from cal join req using (id) where stage_id in ('STAGE_SOWING', 'STAGE_NURSERY', 'STAGE_TRANSPLANTING'))
select id, crop_id, 'crop ' || crop_id crop, 'Season ' || season_id[8:] season, array_to_string(months, ',') sow_months from m where list_contains(months, wanted) qualify row_number() over (partition by id, crop_id order by later, o, season_id, stage_id) = 1""")
def crops_to_sow(spark, d):
    """Which crops can be sown in each customer's month at its place."""
    asked, base, over, _, seasons = _calendar(spark, d)
    crops = base.select("crop_id", F.concat(F.lit("crop "), "crop_id").alias("name")).distinct()
    got = farm.crops_to_sow(asked.drop("crop_id"), base, over, crops, seasons)
    return got.select("id", "crop_id", "crop", "season", F.concat_ws(",", F.transform("sow_months", lambda m: m.cast("string"))).alias("sow_months"))


@query("fertilizer_plans", """with req as (select c_custkey id, 'Brand#' || (c_custkey % 27 + 1) crop_id from customer), need as (select crop_id, f.form, case f.form when 'N' then 60 + sz when 'P2O5' then 20 + sz % 30 else 15 + sz % 20 end::double total, f.b, f.v, f.r from (select p_brand crop_id, max(p_size) + min(p_partkey) sz from part group by p_brand), (values ('N', 0.5, 0.25, 0.25), ('P2O5', 1.0, 0.0, 0.0), ('K2O', 0.6, 0.4, 0.0)) f(form, b, v, r)),
soil as (select c_custkey id, c_acctbal / 20 n, 4 + c_custkey % 60 / 10.0 ph, c_custkey % 5 = 0 untested from customer), st as (select *, case when n < 100 then 'low' when n > 300 then 'high' else 'optimal' end ns, case when ph < 6.5 then 'acidic' when ph > 7.5 then 'alkaline' else 'neutral' end ps from soil),
kg as (select req.id, crop_id, form, b, v, r, floor(total * (1 + case when form = 'N' and not untested then case ns when 'low' then 0.25 when 'high' then -0.25 else 0 end else 0 end)::double * 100 + 0.5) / 100 kg, ns, ps, untested from req join need using (crop_id) join st on st.id = req.id),
dose as (select *, case form when 'P2O5' then kg / 0.46 when 'K2O' then kg / 0.6 else greatest(0, (kg - max(case when form = 'P2O5' then kg / 0.46 * 0.18 end) over (partition by id)) / 0.46) end season from kg),
plan as (select *, unnest(['basal', 'vegetative', 'reproductive']) timing, unnest([b, v, r])::double share from dose)
select '2:' || crop_id || ':' || form || ':' || timing advisory_id, id, timing, form nutrient_form, floor(kg * share * 100 + 0.5) / 100 recommended_kg_ha, case form when 'N' then 'Urea' when 'P2O5' then 'FERT_DAP' else 'FERT_MOP' end product_name, floor(season * share * 100 + 0.5) / 100 product_kg_ha, case when untested then 'not tested' else 'pH=' || ps || '; N=' || ns end soil_status from plan where share > 0""")
def fertilizer_plans(spark, d):
    """Doses by time of application for each customer's crop, with what its soil test adds or takes."""
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    asked = c.select(i.alias("id"), F.concat(F.lit("Brand#"), i % 27 + 1).alias("crop_id"))
    sizes = table(spark, d, "part").groupBy(F.col("p_brand").alias("crop_id")).agg((F.max("p_size") + F.min("p_partkey")).alias("z"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), t.cast("double").alias("total_kg_ha"), *[F.lit(x).alias(n) for n, x in zip(farm.TIMINGS, shares, strict=True)]) for f, t, shares in (("N", 60 + F.col("z"), (0.5, 0.25, 0.25)), ("P2O5", 20 + F.col("z") % 30, (1.0, 0.0, 0.0)), ("K2O", 15 + F.col("z") % 20, (0.6, 0.4, 0.0)))])
    need = sizes.select("crop_id", F.explode(forms).alias("f")).select("crop_id", "f.*")
    tests = c.where(i % 5 != 0).select(i.alias("id"), F.explode(F.create_map(F.lit("available_n"), F.col("c_acctbal") / 20, F.lit("ph"), 4 + (i % 60) / 10.0)).alias("parameter", "value"))
    rules = spark.createDataFrame([("available_n", "N", "kg/ha", "nutrient", 100.0, 300.0, 0.25, "N", "low", "high", 2), ("ph", "pH", "", "condition", 6.5, 7.5, None, None, "lime", "gypsum", 1)], "parameter string, label string, unit string, kind string, low_max double, high_min double, adjustment double, nutrient_form string, low_note string, high_note string, ord int")
    made = spark.createDataFrame([("FERT_UREA", "N", 46.0), ("FERT_DAP", "N", 18.0), ("FERT_DAP", "P2O5", 46.0), ("FERT_SSP", "P2O5", 16.0), ("FERT_MOP", "K2O", 60.0)], "fertilizer_id string, form string, percent double")
    names = spark.createDataFrame([("FERT_UREA", "Urea")], "fertilizer_id string, name string")
    return farm.fertilizer_plans(asked, need, tests, rules, made, names, "2").select("advisory_id", "id", "timing", "nutrient_form", "recommended_kg_ha", "product_name", "product_kg_ha", "soil_status")


RAINS = ("Very heavy rain", "Light showers", "dry", "Scattered")


@query("agromet_advisories", f"""with b as (select n_name district, 'Land ' || n_regionkey state, 20.0 + n_nationkey hi, n_nationkey * 1.0 lo, 50.0 + n_nationkey * 2 hu, {picked_sql('n_nationkey', RAINS)} rain, ['crop_' || (n_nationkey % 3)] crops, n_nationkey ord from nation where n_nationkey % 4 <> 3),
r as (select c_custkey id, case when c_custkey % 3 = 0 then 'land ' || (c_nationkey % 5) else ' Nation_' || c_nationkey end d, 'Crop_' || (c_custkey % 4) crop from customer), e as (select distinct lower(trim(d)) d from r), x as (select e.d, min(ord) ord from e join b on lower(b.district) = e.d group by e.d),
y as (select e.d, min(ord) ord from e join b on (contains(lower(b.district), e.d) or contains(lower(b.state), e.d)) where e.d not in (select d from x) group by e.d), w as (select * from x union all select * from y),
f as (select r.id, r.d, r.crop, b.ord, b.district, coalesce(hi, 25) hi, coalesce(lo, 12) lo, coalesce(hu, 55) hu, coalesce(rain, 'Dry weather') rain, crops from r left join w on w.d = lower(trim(r.d)) left join b on b.ord = w.ord),
g as (select *, case when contains(lower(rain), 'very heavy') then 120 when contains(lower(rain), 'scattered') then 8 when contains(lower(rain), 'light') then 5 else 0 end mm, case lower(crop) when 'crop_0' then 50.0 when 'crop_1' then 30.0 end need from f)
select id, case when ord is null then 'synthetic' else 'bulletin' end data_source, array_to_string(list_filter([case when hi >= 40 then 'heat (high)' end, case when lo <= 4 then 'frost (high)' end, case when hu >= 80 then 'humid (medium)' end, case when mm >= 60 then 'flood (high)' end], lambda z: z is not null), ',') flags,
case when ord is null then 'favourable' when list_contains(crops, lower(crop)) then 'bulletin' else '' end risks, case when need is null then 'unknown' when mm * 7 < 0.5 * need then 'deficit' when mm * 7 > 1.5 * need then 'excess' else 'adequate' end water from g""")
def agromet_advisories(spark, d):
    """For each customer's district and crop: the bulletin that is about it, or the season's baseline, its alerts, and the crop's water."""
    n, c, k = table(spark, d, "nation"), table(spark, d, "customer"), F.col("n_nationkey")
    weather = F.struct((20.0 + k).cast("double").alias("temp_max"), (k * 1.0).cast("double").alias("temp_min"), (50.0 + k * 2).cast("double").alias("humidity"), F.lit(5.0).alias("wind"), picked(k, RAINS).alias("rainfall"))
    said = n.where("n_nationkey % 4 <> 3").select(F.col("n_name").alias("district"), F.concat(F.lit("Land "), "n_regionkey").alias("state"), weather.alias("weather"), F.array(F.concat(F.lit("crop_"), k % 3)).alias("crops"), k.alias("ord"))
    i = F.col("c_custkey")
    asked = c.select(i.alias("id"), F.when(i % 3 == 0, F.concat(F.lit("land "), F.col("c_nationkey") % 5)).otherwise(F.concat(F.lit(" Nation_"), "c_nationkey")).alias("district"), F.concat(F.lit("Crop_"), i % 4).alias("crop"))
    rules = spark.createDataFrame([(1, "heat", "temp_max", ">=", 40.0, "high", ""), (2, "frost", "temp_min", "<=", 4.0, "high", ""), (3, "humid", "humidity", ">=", 80.0, "medium", ""), (4, "flood", "rainfall_mm", ">=", 60.0, "high", "")], "ord int, flag string, metric string, operator string, threshold double, severity string, note string")
    needs = spark.createDataFrame([("crop_0", 50.0), ("crop_1", 30.0)], "crop string, mm_week double")
    got = farm.agromet_advisories(asked, said, rules, needs, F.lit(1))
    return got.select("id", "data_source", F.concat_ws(",", "flags").alias("flags"), F.concat_ws(",", "risks").alias("risks"), "water")


@query("newest_event", """select cast(max(ts) as date)::varchar newest, (date '2024-06-30' - cast(max(ts) as date))::int age_days, case when date '2024-06-30' - cast(max(ts) as date) > 45 then 'WARN' else 'ok' end verdict from events""")
def newest_event(spark, d):
    got = quality.freshness_verdict(table(spark, d, "events"), [F.to_date("ts")], F.lit("2024-06-30").cast("date"))
    return got.select(F.col("newest").cast("string").alias("newest"), "age_days", "verdict")


@query("price_ratios", """select p_brand, floor(cast(sum(p_retailprice::decimal(28, 2)) as double) / count(*) * 100 + 0.5) / 100 mean from part group by p_brand""")
def price_ratios(spark, d):
    """Written as a table, replaced by a new one that reads it, and read back."""
    name = "tessera_prices"
    made = table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_retailprice").cast("decimal(28,2)")).cast("double").alias("total"), F.count("*").alias("n"))
    first = lake.replace_folder(made, f"{shared_folder(spark, 'ratios')}/{name}")
    return first.select("p_brand", half_up(F.col("total") / F.col("n"), 2).alias("mean"))
