"""Advice end to end, for many requests at once: crop plans, crops to sow, fertilizer plans and weather advisories.

Calendars, rules, recipes and bulletins are tables; nothing about a crop is fixed here but how the tables are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions.numbers import half_up
from tessera.operators import advisory, resolve
from tessera.session import spread
from tessera.sources.shared import if_small, kept

# Stages in which a crop is sown and reaped, and the time of application that a stage belongs to.
SOWING, REAPING = ("STAGE_SOWING", "STAGE_NURSERY", "STAGE_TRANSPLANTING"), ("STAGE_HARVEST", "STAGE_MATURITY")
STAGE_TIMING = {
    "nursery": "basal", "sowing": "basal", "germination": "basal", "transplanting": "basal", "establishment": "basal", "tillering": "vegetative", "vegetative": "vegetative",
    "flowering": "reproductive", "fruiting": "reproductive", "fruit_set": "reproductive", "pod_set": "reproductive", "boll_set": "reproductive", "grain_fill": "reproductive",
    "maturity": "reproductive", "harvest": "reproductive", "post_harvest": "reproductive",
}
# Times of application, and the products that supply a nutrient, the first one known.
TIMINGS = ("basal", "vegetative", "reproductive")
PREFERENCE = {"N": ("FERT_UREA",), "P2O5": ("FERT_DAP", "FERT_SSP"), "K2O": ("FERT_MOP", "FERT_SOP")}


_KEY, _ROW = ["crop_id", "season_id", "stage_id"], ["month_start", "month_end", "note"]


def _last(rows: DataFrame, *by: str, level: Column) -> DataFrame:
    """One row for each of `by` and (crop, season, stage): of the highest level, there the last in order; and its first place."""
    best = F.max_by(F.struct(*_ROW, "ord"), F.struct(level, F.col("ord")))
    first = F.col("place") if "place" in rows.columns else F.struct((level > 0).alias("later"), F.col("ord"))
    return rows.groupBy(*by, *_KEY).agg(best.alias("row"), F.min(first).alias("place")).select(*by, *_KEY, "row.*", "place")


def _overriding(requests: DataFrame, overrides: DataFrame, on: list[str]) -> DataFrame:
    """Overrides that hold where a request is: level 1 of its state (without a district), 2 of its district.

    Of each state's and district's rows for a stage the last one and its first place are taken before requests meet them.
    """
    columns = [*_KEY, *_ROW, "ord", "place"]
    around = _last(overrides.where("coalesce(district_code, '') = ''"), "state_code", level=F.lit(1))
    there = _last(overrides.where("district_code <> ''"), "district_code", level=F.lit(2))
    a = requests.select("id", "state_code", *on).join(if_small(around), ["state_code", *on]).select("id", *columns, F.lit(1).alias("level"))
    return a.unionByName(requests.select("id", "district_code", *on).join(if_small(there), ["district_code", *on]).select("id", *columns, F.lit(2).alias("level")))


def located(requests: DataFrame, calendar: DataFrame, overrides: DataFrame) -> DataFrame:
    """The calendar of its crop as it holds for each request (id, crop_id, state_code, district_code).

    calendar has crop_id, season_id, stage_id, month_start, month_end, note, ord; overrides state_code and district_code too. For each
    (crop, season, stage) a district's row counts before a state's (without a district) and that before the base's; of
    several at one level the last in order counts. Requests meet both by equality.
    """
    known = _last(calendar, level=F.lit(0))  # the base is the same for all requests
    base = requests.select("id", "crop_id").join(if_small(known), "crop_id").withColumn("level", F.lit(0))
    over = _overriding(requests, overrides, ["crop_id"])
    return _last(base.unionByName(over), "id", level=F.col("level"))


def crop_plans(requests: DataFrame, calendar: DataFrame, overrides: DataFrame, stages: DataFrame, seasons: DataFrame) -> DataFrame:
    """(id, crop_id, seasons, timeline, sow_window, harvest_window, duration_months) for requests whose crop has a calendar.

    The timeline goes by season and first month; sowing months go round the year from June, harvest months by the timeline.
    """
    rows = located(requests, calendar, overrides).withColumn("months", dates.months(F.col("month_start"), F.col("month_end")))
    rows = resolve.labelled(rows, "stage_id", stages.select("stage_id", F.col("name").alias("stage_name")), "stage_name", "stage")
    rows = resolve.labelled(rows, "season_id", seasons.select("season_id", F.col("name").alias("season_name")), "season_name", "season")
    line = F.array_sort(F.collect_list(F.struct("season_id", "month_start", "place", "stage_id", "stage", "months", "note", "season")))
    out = rows.groupBy("id", "crop_id").agg(line.alias("line"))
    months_of = lambda kinds: F.array_distinct(F.flatten(F.transform(F.filter("line", lambda r: r["stage_id"].isin(*kinds)), lambda r: r["months"])))
    return out.select(
        "id",
        "crop_id",
        F.transform(F.array_distinct(F.transform("line", lambda r: F.struct(r["season_id"].alias("i"), r["season"].alias("s")))), lambda x: x["s"]).alias("seasons"),
        F.transform("line", lambda r: F.struct(r["stage"].alias("stage"), r["months"].alias("months"), r["note"].alias("note"))).alias("timeline"),
        F.transform(F.array_sort(F.transform(months_of(SOWING), lambda m: F.struct(F.pmod(m - 6, F.lit(12)).alias("away"), m.alias("m")))), lambda x: x["m"]).alias("sow_window"),
        months_of(REAPING).alias("harvest_window"),
        F.size(F.array_distinct(F.flatten(F.transform("line", lambda r: r["months"])))).alias("duration_months"),
    )


def sow_risk(window: Column, month: Column) -> Column:
    """on_window, near_window (a sowing month within the next two), off_window, or unknown."""
    ahead = dates.months_until(month, window)
    return F.when(F.coalesce(F.size(window), F.lit(0)) <= 0, "unknown").when(ahead == 0, "on_window").when(ahead <= 2, "near_window").otherwise("off_window")


def crops_to_sow(requests: DataFrame, calendar: DataFrame, overrides: DataFrame, crops: DataFrame, seasons: DataFrame) -> DataFrame:
    """(id, crop_id, crop, season, sow_months): crops with a sowing stage in the month of each request (id, month, state_code, district_code).

    Months of the base calendar meet requests by equality; a request's overrides then take the place of the stages that
    they are about. Of several stages of a crop the first in the calendar's order counts. What can be sown depends on month and
    place alone, so it is found once for each of them and then joined to the requests; an id that comes with several counts as
    one request with all of them, and rows without an id get nothing.
    """
    sowing = lambda rows: rows.where(F.col("stage_id").isin(*SOWING)).withColumn("sow_months", dates.months(F.col("month_start"), F.col("month_end")))
    where = F.array_sort(F.collect_set(F.struct("month", "state_code", "district_code")))
    asked = kept(requests.where("id is not null").groupBy(F.col("id").alias("asked")).agg(where.alias("id")), "asked")
    requests = kept(asked.select("id").distinct().select("id", F.explode("id").alias("x")).select("id", "x.*"), "places")
    base = sowing(_last(calendar, level=F.lit(0))).withColumn("month", F.explode("sow_months"))
    over = sowing(_last(_overriding(requests, overrides, []), "id", level=F.col("level")))
    columns = ["id", *_KEY, "sow_months", "place"]
    free = requests.select("id", "month").join(if_small(base), "month").join(over.select("id", *_KEY), ["id", *_KEY], "left_anti").select(*columns)
    rows = free.unionByName(over.join(requests.select("id", "month"), "id").where(F.array_contains("sow_months", F.col("month"))).select(*columns))
    first = rows.groupBy("id", "crop_id").agg(F.min_by(F.struct("season_id", "sow_months"), F.struct("place", "season_id", "stage_id")).alias("f")).select("id", "crop_id", "f.*")
    named = resolve.labelled(first, "crop_id", crops.select("crop_id", F.col("name").alias("crop_name")), "crop_name", "crop")
    named = resolve.labelled(named, "season_id", seasons.select("season_id", F.col("name").alias("season_name")), "season_name", "season")
    answers = kept(named.select("id", "crop_id", "crop", "season", "sow_months"), "answers")
    return spread(asked).join(if_small(answers), "id").select(F.col("asked").alias("id"), "crop_id", "crop", "season", "sow_months")


def timing_of(stage: Column) -> Column:
    """The time of application of a stage, by its whole name, else by its first word."""
    key = F.replace(F.lower(F.trim(stage)), F.lit(" "), F.lit("_"))
    names = F.create_map(*[F.lit(x) for pair in STAGE_TIMING.items() for x in pair])
    return F.coalesce(names[key], names[F.substring_index(key, "_", 1)])


def soil_status(kind: Column, parameter: Column, value: Column, low: Column, high: Column) -> Column:
    """What a value means by its rule: reaction, salts, micronutrients, and the rest."""
    reaction = F.when(value < low, "acidic").when(value > high, "alkaline").otherwise("neutral")
    salts = F.when(value <= low, "normal").when(value <= high, "saline").otherwise("critical")
    micro = F.when(value < low, "deficient").otherwise("sufficient")
    plain = F.when(value < low, "low").when(value > high, "high").otherwise("optimal")
    return F.when((kind == "condition") & (parameter == "ph"), reaction).when(kind == "condition", salts).when(kind == "micro", micro).otherwise(plain)


def assessed(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """Soil tests (id, parameter, value) with label, status, nutrient_form, adjustment and note of their rule, by ord."""
    both = tests.where("value is not null").join(if_small(rules), "parameter")
    status = soil_status(F.col("kind"), F.col("parameter"), F.col("value"), F.col("low_max"), F.col("high_min"))
    out = both.withColumn("status", status)
    note = F.when(F.col("status").isin("low", "acidic", "deficient"), F.col("low_note")).when(F.col("status").isin("high", "alkaline", "saline", "critical"), F.col("high_note"))
    return out.withColumn("note", note).select("id", "parameter", "label", "value", "unit", "status", "note", "nutrient_form", "adjustment", "ord")


def fertilizer_plans(requests: DataFrame, requirement: DataFrame, tests: DataFrame, rules: DataFrame, composition: DataFrame, names: DataFrame, version: str = "1") -> DataFrame:
    """Versioned records (advisory_id, id, crop_id, timing, nutrient_form, recommended_kg_ha, product_id, product_name, product_kg_ha, share, soil_status).

    requirement has crop_id, form, total_kg_ha and a share for each of TIMINGS; a soil that is low in a nutrient raises its need by
    the rule's adjustment and one that is high lowers it. Phosphate comes first, since the nitrogen of its product counts; the rest
    of the nitrogen and potash follow. composition has fertilizer_id, form, percent.
    """
    soil = assessed(tests, rules)
    step = F.sum(F.when(F.col("status") == "low", F.col("adjustment")).when(F.col("status") == "high", -F.col("adjustment")).otherwise(0.0))
    changes = soil.where(F.col("nutrient_form").isin(*PREFERENCE)).groupBy("id", F.col("nutrient_form").alias("form")).agg(step.alias("step"))
    said = soil.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "status"))), lambda x: F.concat(x["label"], F.lit("="), x["status"])), "; ").alias("soil_status"))
    need = requests.select("id", "crop_id").join(if_small(requirement.where(F.col("form").isin(*PREFERENCE))), "crop_id").join(changes, ["id", "form"], "left")
    need = need.withColumn("kg", half_up(F.col("total_kg_ha") * (1.0 + F.coalesce("step", F.lit(0.0))), 2))

    # the product of each nutrient, and the shares of its own nutrient and of nitrogen in it: three rows
    ranks = [(form, product, n) for form, products in PREFERENCE.items() for n, product in enumerate(products)]
    known = composition.select("fertilizer_id", F.upper("form").alias("has"), F.col("percent") / 100.0)
    preferred = composition.sparkSession.createDataFrame(ranks, "form string, fertilizer_id string, n int").join(known.toDF("fertilizer_id", "has", "part"), "fertilizer_id")
    chosen = preferred.groupBy("form", "fertilizer_id", "n").agg(F.max(F.when(F.col("has") == F.col("form"), F.col("part"))).alias("own"), F.max(F.when(F.col("has") == "N", F.col("part"))).alias("nitrogen"))
    chosen = chosen.groupBy("form").agg(F.min_by(F.struct(F.col("fertilizer_id").alias("product_id"), "own", "nitrogen"), "n").alias("p")).select("form", "p.*")
    dosed = need.join(if_small(chosen), "form")
    plain = F.coalesce(F.try_divide("kg", "own"), F.lit(0.0))
    credit = F.sum(F.when(F.col("form") == "P2O5", plain * F.coalesce("nitrogen", F.lit(0.0)))).over(Window.partitionBy("id"))
    season = F.when(F.col("form") == "N", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("kg") - F.coalesce(credit, F.lit(0.0)), "own"), F.lit(0.0)))).otherwise(plain)
    dosed = dosed.withColumn("season_kg", season)
    shares = F.explode(F.array(*[F.struct(F.lit(t).alias("timing"), F.col(t).alias("share")) for t in TIMINGS]))
    plan = dosed.select("id", "crop_id", "form", "kg", "product_id", "season_kg", shares.alias("s")).where("s.share > 0")
    plan = resolve.labelled(plan, "product_id", names.select("fertilizer_id", F.col("name").alias("fertilizer")), "fertilizer", "product_name").join(said, "id", "left")
    return plan.select(
        F.concat_ws(":", F.lit(version), "crop_id", "form", "s.timing").alias("advisory_id"), "id", "crop_id", F.col("s.timing").alias("timing"), F.col("form").alias("nutrient_form"),
        half_up(F.col("kg") * F.col("s.share"), 2).alias("recommended_kg_ha"), "product_id", "product_name", half_up(F.col("season_kg") * F.col("s.share"), 2).alias("product_kg_ha"),
        half_up(F.col("s.share"), 4).alias("share"), F.coalesce("soil_status", F.lit("not tested")).alias("soil_status"),
    )


def weather_alerts(weather: Column, rules: Column) -> Column:
    """The rules (array of structs flag, metric, operator, threshold, severity, note) that a struct of metrics meets: >= as said, else <=."""

    def value(r: Column) -> Column:
        out = F.lit(None).cast("double")
        for metric in ("temp_max", "temp_min", "humidity", "wind", "rainfall_mm"):
            out = F.when(r["metric"] == metric, weather[metric].cast("double")).otherwise(out)
        return out

    return F.filter(rules, lambda r: F.when(r["operator"] == ">=", value(r) >= r["threshold"]).otherwise(value(r) <= r["threshold"]))


# Bands of a day's rain in mm, and what they are called; months and what the weather is like where nothing is known.
SEASONAL = (
    ((6, 7, 8, 9), 31.0, 24.0, 80.0, 14.0, "Scattered monsoon showers", 12.0), ((10, 11), 30.0, 20.0, 65.0, 8.0, "Clear skies with light showers", 2.0),
    ((12, 1, 2), 25.0, 12.0, 55.0, 7.0, "Dry weather", 0.0), ((3, 4, 5), 39.0, 26.0, 40.0, 15.0, "Dry hot conditions", 0.0),
)


def rain_text(mm: Column) -> Column:
    """A day's rain in words: beyond 15 mm, beyond 2 mm, else dry."""
    amount = F.concat(F.lit("("), mm.cast("string"), F.lit(" mm)"))
    return F.when(mm > 15, F.concat(F.lit("Moderate to heavy rain "), amount)).when(mm > 2, F.concat(F.lit("Light rain/showers "), amount)).otherwise("Dry conditions / no significant rainfall")


def seasonal_weather(month: Column) -> Column:
    """A baseline by month where there is neither a bulletin nor an observation; it is no observation."""
    out = None
    for months, high, low, humidity, wind, rain, mm in reversed(SEASONAL):
        made = F.struct(F.lit(high).alias("temp_max"), F.lit(low).alias("temp_min"), F.lit(humidity).alias("humidity"), F.lit(wind).alias("wind"), F.lit(rain).alias("rainfall"), F.lit(mm).alias("precipitation_mm"))
        out = made if out is None else F.when(month.isin(*months), made).otherwise(out)
    return out


#: Rules that a table of weather alerts may have; they are looked at for each row.
MOST_RULES = 1000
# Metrics, bounds and the risk that they stand for.
CROP_RISKS = (("humidity", ">=", 75.0, 50.0, "fungal"), ("temp_max", ">=", 38.0, 30.0, "heat"), ("temp_min", "<=", 8.0, 20.0, "cold"), ("wind", ">=", 25.0, 10.0, "wind"))


def crop_risks(weather: Column) -> Column:
    """Kinds of risk that the weather is for a crop, or favourable; a metric that isn't known counts as a usual one."""
    hits = []
    for metric, op, bound, usual, kind in CROP_RISKS:
        v = F.coalesce(weather[metric].cast("double"), F.lit(usual))
        hits.append(F.when(v >= bound if op == ">=" else v <= bound, F.lit(kind)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("favourable")))


def agromet_advisories(requests: DataFrame, bulletins: DataFrame, rules: DataFrame, needs: DataFrame, month: Column) -> DataFrame:
    """(id, district, data_source, flags, crop, risks, water) for each request (id, district, crop).

    A bulletin (district, state, weather: struct of temp_max, temp_min, humidity, wind and rainfall, crops: array of names, ord) is taken
    by the district's exact name, else if its district or state contains the request's, the first in order. Without one the
    seasonal baseline of the month stands in, and data_source says so. water compares the rain, as a week's, with the crop's
    need (crop, mm_week). rules are a table of a few rows.
    """
    asked = requests.select("id", "crop", F.lower(F.trim("district")).alias("d_"), "district")
    said = bulletins.select("ord", F.lower(F.trim("district")).alias("b_"), F.lower(F.trim("state")).alias("s_"), F.col("district").alias("b_district"), "weather", "crops")
    names = asked.select("d_").distinct()
    exact = names.join(said.select("b_", "ord"), F.col("d_") == F.col("b_")).select("d_", "ord", F.lit(0).alias("level"))
    rest = names.where("d_ <> ''").join(exact.select("d_").distinct(), "d_", "left_anti")
    near = rest.join(if_small(said.select("b_", "s_", "ord").distinct()), F.contains("b_", "d_") | F.contains("s_", "d_")).select("d_", "ord", F.lit(1).alias("level"))
    best = exact.unionByName(near).groupBy("d_").agg(F.min(F.struct("level", "ord")).alias("m")).select("d_", "m.ord")
    found = asked.join(best, "d_", "left").join(said.drop("b_", "s_"), "ord", "left")
    base, parts = seasonal_weather(month), ("temp_max", "temp_min", "humidity", "wind", "rainfall")
    told = F.struct(*[F.col(f"weather.{m}").cast("string" if m == "rainfall" else "double").alias(m) for m in parts])
    weather = F.when(F.col("weather").isNull(), F.struct(*[base[m].alias(m) for m in parts])).otherwise(told)
    full = found.withColumn("w", weather).withColumn("rain", advisory.rain_of(F.col("w.rainfall")))
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names_ = ("flag", "metric", "operator", "threshold", "severity", "note")
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in names_]) for r in rules.orderBy("ord").select(*names_).collect()])
    metrics = F.struct(*[F.col(f"w.{m}").alias(m) for m in ("temp_max", "temp_min", "humidity", "wind")], F.col("rain").alias("rainfall_mm"))
    flags = F.transform(weather_alerts(metrics, listed), lambda r: F.concat(r["flag"], F.lit(" ("), r["severity"], F.lit(")")))
    need = if_small(needs.select(F.lower("crop").alias("c_"), "mm_week"))
    out = full.withColumn("flags", flags).withColumn("week", F.col("rain") * 7.0).join(need, F.lower("crop") == F.col("c_"), "left")
    water = F.when(F.col("mm_week").isNull(), "unknown").when(F.col("week") < 0.5 * F.col("mm_week"), "deficit").when(F.col("week") > 1.5 * F.col("mm_week"), "excess").otherwise("adequate")
    listed_crop = F.exists("crops", lambda c: F.lower(c) == F.lower(F.col("crop")))
    risks = F.when(F.col("ord").isNull(), crop_risks(F.col("w"))).when(F.coalesce(listed_crop, F.lit(False)), F.array(F.lit("bulletin"))).otherwise(F.array().cast("array<string>"))
    return out.select("id", F.coalesce("b_district", F.initcap("district")).alias("district"), F.when(F.col("ord").isNull(), "synthetic").otherwise("bulletin").alias("data_source"), "flags", "crop", risks.alias("risks"), water.alias("water"))

