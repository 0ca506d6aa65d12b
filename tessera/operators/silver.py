"""Raw rows of each kind of source as canonical records.

Every map takes the raw table and two lookups: crops (key, target, priority, ord) with their attributes, and places. Raw columns may
come under several names; the first that a table has and a row fills counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.operators import resolve
from tessera.sources.shared import if_small

# Prefixes of record ids, names and ids of sources, by kind of record.
SOURCES = {
    "market": ("AMN", "Agmarknet", "GOI_AGMARKNET"),
    "dashboard": ("AMND", "Agmarknet dashboard (marketwise price arrival)", "AGMARKNET_DASHBOARD"),
    "question": ("KCC", "Kisan Call Centre", "GOI_KCC"),
    "weather": ("IMD", "IMD Agromet Advisory Service", "IMD_AAS"),
    "soil": ("SHC", "Soil Health Card", "GOI_SHC"),
}
# Seasons, in the order they are looked for in a text.
SEASONS = ("kharif", "rabi", "zaid", "summer", "whole_year", "perennial")
SOIL_TESTS = ("N", "P", "K", "S", "Zn", "Fe", "Cu", "Mn", "B", "pH", "EC", "OC")
UNIT = "INR/quintal"


def first_of(raw: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that the table has, trimmed; null without any."""
    known = {c.lower(): c for c in raw.columns}
    found = [F.nullif(F.trim(F.col(f"`{known[n.lower()]}`").cast("string")), F.lit("")) for n in dict.fromkeys(x.lower() for x in names) if n in known]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def number(x: Column) -> Column:
    """A number with commas between its digits; null where it isn't one."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def first_number(raw: DataFrame, *names: str) -> Column:
    """The first of the columns that holds a number."""
    known = {c.lower(): c for c in raw.columns}
    found = [number(F.trim(F.col(f"`{known[n.lower()]}`").cast("string"))) for n in dict.fromkeys(names) if n.lower() in known]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def season_of(x: Column) -> Column:
    """The first of SEASONS that a text names, with _ or a space between its words."""
    low, out = F.lower(F.coalesce(x, F.lit(""))), F.lit(None).cast("string")
    for season in reversed(SEASONS):
        out = F.when(F.contains(low, F.lit(season.replace("_", " "))) | F.contains(low, F.lit(season)), season).otherwise(out)
    return out


def with_crop(rows: DataFrame, mention: str, crops: DataFrame, attributes: DataFrame, prefix: str = "crop") -> DataFrame:
    """rows with the crop that a column names: its id under `prefix`, and <prefix>_canonical and <prefix>_scientific_name."""
    found = resolve.resolve(rows, mention, crops).withColumnRenamed("target", prefix).drop("match")
    about = if_small(attributes.select(F.col("crop_id").alias("c_"), F.col("canonical_en").alias(f"{prefix}_canonical"), F.col("scientific_name").alias(f"{prefix}_scientific_name")))
    return found.join(about, F.col(prefix) == F.col("c_"), "left").drop("c_")


def with_place(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (state, district) with state_code, district_code and agroclimatic_zone of places (state, district, and these).

    A district counts within its state, or, without a state, the first of that name; a state alone gives its own code.
    """
    name = lambda c: T.normalise(F.col(c))
    key = places.select(name("state").alias("s_"), name("district").alias("d_"), "state_code", "district_code", "agroclimatic_zone")
    both = key.where("d_ <> ''").groupBy("s_", "d_").agg(F.min(F.struct("state_code", "district_code", "agroclimatic_zone")).alias("a_"))
    alone = key.groupBy("s_").agg(F.min("state_code").alias("b_"))
    anywhere = key.where("d_ <> ''").groupBy("d_").agg(F.min(F.struct("state_code", "district_code", "agroclimatic_zone")).alias("e_"))
    out = rows.withColumn("s_", F.coalesce(name("state"), F.lit(""))).withColumn("d_", F.coalesce(name("district"), F.lit("")))
    out = out.join(if_small(both), ["s_", "d_"], "left").join(if_small(alone), "s_", "left").join(if_small(anywhere.withColumnRenamed("d_", "f_")), (F.col("s_") == "") & (F.col("d_") == F.col("f_")), "left")
    pick = lambda c: F.coalesce(F.col(f"a_.{c}"), F.col(f"e_.{c}"))
    return out.withColumns({"state_code": F.coalesce(pick("state_code"), F.col("b_")), "district_code": pick("district_code"), "agroclimatic_zone": pick("agroclimatic_zone")}).drop("s_", "d_", "f_", "a_", "b_", "e_")


def _stamped(rows: DataFrame, kind: str, record_id: Column, url: Column, id_: str = "record_id", level: str = "government") -> DataFrame:
    _, name, source = SOURCES[kind]
    return rows.withColumns({id_: record_id, "source": F.lit(name), "source_id": F.lit(source), "country": F.lit("IN"), "authority": F.lit("government"), "authority_level": F.lit(level), "source_url": url})


def _dated(rows: DataFrame, said: str, formats: tuple[str, ...] = dates.FORMATS) -> DataFrame:
    """price_date as ISO text, or as it stands where it isn't a date, and price_date_raw where the two differ."""
    iso = F.coalesce(dates.iso(dates.parse(F.col(said), formats)), F.col(said))
    return rows.withColumn("price_date", iso).withColumn("price_date_raw", F.when(F.col(said) != F.col("price_date"), F.col(said))).drop(said)


def market_prices(raw: DataFrame, crops: DataFrame, attributes: DataFrame, places: DataFrame, url: str = "") -> DataFrame:
    """One record for each row of a market feed, which is the first to say day before month."""
    price = lambda kind: first_number(raw, f"{kind.title()} Price (Rs./Quintal)", f"{kind.title()}_x0020_Price", f"{kind.title()}_Price", f"{kind}_price")
    rows = raw.select(
        first_of(raw, "State").alias("state"), first_of(raw, "District").alias("district"), first_of(raw, "Market", "APMC").alias("market"), first_of(raw, "Commodity").alias("commodity_raw"),
        first_of(raw, "Variety").alias("variety"), first_of(raw, "Grade").alias("grade"), price("min").alias("min_price"), price("max").alias("max_price"), price("modal").alias("modal_price"),
        F.lit(UNIT).alias("unit"), first_of(raw, "Arrival_Date", "Price Date").alias("said_"),
    )
    rows = with_place(with_crop(_dated(rows, "said_", ("dd/MM/yyyy", *dates.FORMATS)), "commodity_raw", crops, attributes), places)
    slug = lambda c: T.slug(F.coalesce(F.col(c), F.lit("NA")))
    return _stamped(rows, "market", F.concat_ws("-", F.lit(SOURCES["market"][0]), slug("market"), slug("commodity_raw"), F.coalesce("price_date", F.lit("nodate"))), F.lit(url))


def dashboard_prices(raw: DataFrame, crops: DataFrame, attributes: DataFrame, places: DataFrame, url: str = "") -> DataFrame:
    """A district's averages by commodity; rows without a commodity are left out. raw has state_name, district_name and district_id too."""
    rows = raw.where(F.coalesce(F.trim("cmdt_name"), F.lit("")) != "").select(
        F.col("state_name").alias("state"), F.col("district_name").alias("district"), F.col("district_id").cast("string").alias("place_"), F.lit(None).cast("string").alias("market"), F.trim("cmdt_name").alias("commodity_raw"),
        F.col("cmdt_grp_name").alias("commodity_group"), number(F.col("as_on_price").cast("string")).alias("modal_price"), number(F.col("one_day_ago_price").cast("string")).alias("prev_day_price"),
        number(F.col("two_day_ago_price").cast("string")).alias("prev_2day_price"), number(F.col("as_on_arrival").cast("string")).alias("arrival_tonnes"), number(F.col("msp_price").cast("string")).alias("msp_price"),
        F.nullif(F.lower(F.trim("trend")), F.lit("")).alias("trend"), F.lit(UNIT).alias("unit"), F.nullif(F.trim("reported_date"), F.lit("")).alias("said_"), F.lit("district_average").alias("price_kind"),
    )
    rows = with_place(with_crop(_dated(rows, "said_", ("dd-MM-yyyy", *dates.FORMATS)), "commodity_raw", crops, attributes), places)
    return _stamped(rows, "dashboard", F.concat_ws("-", F.lit(SOURCES["dashboard"][0]), "place_", F.left("commodity_raw", F.lit(32)), F.coalesce("price_date", F.lit("nodate"))), F.lit(url)).drop("place_")


def questions(raw: DataFrame, crops: DataFrame, attributes: DataFrame, places: DataFrame, categories: dict[str, str], url: str = "") -> DataFrame:
    """A farmer's question and its answer; the language is that of the question's script, the month that of an ISO date."""
    created = first_of(raw, "createdon")
    empty = lambda c: F.coalesce(c, F.lit(""))
    sector = F.lower(first_of(raw, "sector"))
    known = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map(F.lit(""), F.lit(""))
    rows = raw.select(
        first_of(raw, "statename").alias("state"), first_of(raw, "districtname").alias("district"), first_of(raw, "blockname").alias("block"), empty(first_of(raw, "querytext")).alias("query_original"),
        empty(first_of(raw, "kccans", "KCCAnswer")).alias("answer_original"), season_of(first_of(raw, "season")).alias("season"), first_of(raw, "crop").alias("said_"), F.coalesce(known[sector], sector).alias("category"),
        first_of(raw, "querytype").alias("subcategory"), F.when(F.substring(created, 5, 1) == "-", F.substring(created, 6, 2).try_cast("int")).alias("month"), empty(F.left(created, F.lit(7))).alias("when_"),
        empty(first_of(raw, "_id")).alias("no_"), F.lit(True).alias("expert_verified"),
    )
    rows = rows.withColumn("answer_normalized", F.trim("answer_original")).withColumn("farmer_language", T.detect_language(F.col("query_original"))["language"])
    rows = with_place(with_crop(rows, "said_", crops, attributes), places)
    id_ = F.concat_ws("-", F.lit(SOURCES["question"][0]), F.coalesce("state", F.lit("XX")), F.coalesce("district", F.lit("XX")), "when_", "no_")
    return _stamped(rows, "question", id_, F.lit(url), "query_id", "government_extension").drop("said_", "when_", "no_")


def bulletins(raw: DataFrame, crops: DataFrame, attributes: DataFrame, places: DataFrame) -> DataFrame:
    """A weather bulletin; the crop of each of its notes (crop, growth_stage, risk, action) is resolved, and the notes keep their order."""
    numbered = raw.withColumn("n_", F.monotonically_increasing_id())
    notes = numbered.select("n_", F.posexplode("crop_advisories").alias("i_", "a_")).select("n_", "i_", F.col("a_.crop").alias("said_"), "a_.growth_stage", "a_.risk", "a_.action")
    made = with_crop(notes, "said_", crops, attributes).groupBy("n_").agg(F.array_sort(F.collect_list(F.struct("i_", "crop", "crop_canonical", "growth_stage", "risk", "action"))).alias("x_"))
    kept = F.transform("x_", lambda x: F.struct(*[x[c].alias(c) for c in ("crop", "crop_canonical", "growth_stage", "risk", "action")]))
    rows = numbered.drop("crop_advisories").join(made, "n_", "left").withColumn("crop_advisories", F.coalesce(kept, F.array().cast("array<struct<crop:string,crop_canonical:string,growth_stage:string,risk:string,action:string>>"))).drop("n_", "x_")
    return _stamped(with_place(rows, places), "weather", F.concat_ws("-", F.lit(SOURCES["weather"][0]), "state", "valid_from"), F.col("source_url"))


def soil_cards(raw: DataFrame, crops: DataFrame, attributes: DataFrame, places: DataFrame) -> DataFrame:
    """A soil card with its tests packed into soil_test, and the crops before and after it resolved."""
    tests = F.struct(*[(F.col(t) if t in raw.columns else F.lit(None)).cast("double").alias(t) for t in SOIL_TESTS])
    rows = raw.withColumn("soil_test", tests).drop(*SOIL_TESTS)
    for when in ("previous", "target"):
        said = with_crop(rows.withColumnRenamed(f"{when}_crop", "said_"), "said_", crops, attributes)
        rows = said.withColumnRenamed("crop", f"{when}_crop").drop("said_", "crop_canonical", "crop_scientific_name")
    return _stamped(with_place(rows, places), "soil", F.concat_ws("-", F.lit(SOURCES["soil"][0]), "state", "district", "sample_id"), F.col("source_url"))


def article_chunks(pages: DataFrame, url: str, html: str, licence: Column, copyright_: Column, retrieved: Column, longest: int = 1000) -> DataFrame:
    """Attributed pieces of pages: chunk_id and content_hash are digests of the piece and of the whole text."""
    whole = pages.withColumn("whole_", T.page_text(F.col(html)))
    rows = whole.select("*", F.explode(T.slices(F.col("whole_"), longest)).alias("piece_")).withColumn("text", F.trim("piece_")).where("text <> ''")
    return rows.select(
        F.left(F.sha2("text", 256), F.lit(16)).alias("chunk_id"), F.col(url).alias("source_url"), F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("publisher"), T.page_title(F.col(html)).alias("title"),
        retrieved.alias("retrieved_date"), licence.alias("license"), copyright_.alias("copyright_status"), F.sha2("whole_", 256).alias("content_hash"), T.detect_language(F.col("whole_"))["language"].alias("language"), "text",
    )
