"""Records put right: dates, units, personal data, identity, and places by name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.functions.numbers import half_up
from tessera.sources.shared import if_small

# Names of date formats, the columns of free text that are cleaned, units of prices, and names of the country.
NAMED_FORMATS = {"ISO8601": ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss"), "DD/MM/YYYY": ("dd/MM/yyyy",), "DD-MM-YYYY": ("dd-MM-yyyy",), "YYYY/MM/DD": ("yyyy/MM/dd",), "YYYYMMDD": ("yyyyMMdd",), "DD MMM YYYY": ("dd MMM yyyy",), "MM/DD/YYYY": ("MM/dd/yyyy",)}
FALLBACK = ("ISO8601", "DD/MM/YYYY", "YYYY/MM/DD", "DD-MM-YYYY")
COMMON_DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
TEXT_FIELDS = ("query_original", "answer_original", "answer_normalized", "text")
PRICES = ("min_price", "modal_price", "max_price")
PER_TONNE = {"inr/tonne": 10.0, "rs/tonne": 10.0, "inr/quintal": 1.0, "rs/quintal": 1.0}
COUNTRY = ("in", "ind", "india", "bharat", "भारत")


def run_id(prefix: str = "run", now: str | None = None) -> str:
    """prefix, the time to the second, and eight hexadecimal digits by chance."""
    import datetime as dt

    stamp = now or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    return f"{prefix}-{stamp}-{uuid.uuid4().hex[:8]}"


def parsed_as(x: Column, name: str | None = None) -> Column:
    """A timestamp by a named format, or without one by those of FALLBACK; an unknown name is an error."""
    if name is not None and name.upper() not in NAMED_FORMATS:
        raise ValueError(f"unknown date format {name}")
    names = (name.upper(),) if name else FALLBACK
    return dates.parse(x, tuple(f for n in names for f in NAMED_FORMATS[n]))


def common_date(x: Column) -> Column:
    """A day by the usual formats; what follows a day that is complete doesn't matter."""
    t = F.trim(x)
    whole = [F.try_to_timestamp(t, F.lit(f)) for f in COMMON_DATES]
    return F.to_date(F.coalesce(*whole, *[F.try_to_timestamp(F.left(t, F.lit(10)), F.lit(f)) for f in COMMON_DATES[:4]]))


def canonical_dates(rows: DataFrame, formats: dict[str, str | None]) -> DataFrame:
    """Columns as ISO text, <column>_raw where that changed them, and problems: array<string>, one for each that doesn't parse."""
    out, problems = rows, []
    for c, name in formats.items():
        iso = dates.iso(parsed_as(F.col(c), name))
        given = F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
        problems.append(F.when(given & iso.isNull(), F.concat(F.lit(f"{c}="), F.col(c), F.lit(f" does not parse as {name or 'a known date format'}"))))
        out = out.withColumn(f"{c}_raw", F.when(given & iso.isNotNull() & (iso != F.col(c)), F.col(c))).withColumn(f"{c}_new", F.when(given, F.coalesce(iso, F.col(c))).otherwise(F.col(c)))
    found = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    out = out.withColumn("problems", found)
    for c in formats:
        out = out.withColumn(c, F.col(f"{c}_new")).drop(f"{c}_new")
    return out


def refined(rows: DataFrame, formats: dict[str, str | None], fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """canonical_dates, contact details masked in the columns of free text, and pii_redacted and pii_kinds."""
    out = canonical_dates(rows, formats)
    there = [c for c in fields if c in rows.columns]
    kinds = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(T.pii_kinds(F.col(c)), F.array().cast("array<string>")) for c in there]))) if there else F.array().cast("array<string>")
    out = out.withColumn("pii_kinds", kinds).withColumn("pii_redacted", F.size("pii_kinds") > 0)
    return out.withColumns({c: T.redact(F.col(c)) for c in there}) if there else out


def priced_in(rows: DataFrame, target: str = "INR/quintal") -> DataFrame:
    """Prices in one unit; a unit that isn't known, and no unit, leave them as they are."""
    now, then = PER_TONNE[target.lower()], F.lit(None).cast("double")
    for name, factor in PER_TONNE.items():
        then = F.when(F.lower("unit") == name, F.lit(factor)).otherwise(then)
    factor = then / now  # a price for a tonne is ten times that for a quintal
    changed = F.coalesce(factor != 1.0, F.lit(False))
    out = rows.withColumns({c: F.when(changed, half_up(F.col(c) / factor, 2)).otherwise(F.col(c)) for c in PRICES if c in rows.columns})
    return out.withColumn("unit", F.when(changed | F.col("unit").isNull(), F.lit(target)).otherwise(F.col("unit")))


def mark_value(x: Column, kind: str, formats: tuple[str, ...] = dates.FORMATS) -> Column:
    """The value of a high-water mark: a day or time as ISO text, so that it sorts, and anything else as text."""
    if kind not in ("date", "datetime"):
        return F.nullif(x.cast("string"), F.lit(""))
    ts = dates.parse(x.cast("string"), formats)
    said = F.date_format(ts, "yyyy-MM-dd") if kind == "date" else F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(said, F.nullif(x.cast("string"), F.lit("")))


def country_code(x: Column) -> Column:
    return F.when(T.normalise(x).isin(*COUNTRY), "IN")


def subdistricts(requests: DataFrame, places: DataFrame, known: DataFrame) -> DataFrame:
    """requests (id, name, state, district) with type, state_code and district_code of places (name, type, state_code, district_code, ord).

    known (state, district, state_code, district_code) turns the hints into codes. A state that resolves must fit; a district must
    fit by its code, or by the last part of its code as a name. A place in the very district comes first, then the first in order.
    """
    n = T.normalise
    asked = requests.select("id", n(F.col("name")).alias("n_"), F.coalesce(n(F.col("state")), F.lit("")).alias("s_"), F.coalesce(n(F.col("district")), F.lit("")).alias("d_"))
    states = known.groupBy(n(F.col("state")).alias("s_")).agg(F.min("state_code").alias("want_state"))
    districts = known.groupBy(n(F.col("state")).alias("s_"), n(F.col("district")).alias("d_")).agg(F.min("district_code").alias("want_district"))
    hinted = asked.join(if_small(states), "s_", "left").join(if_small(districts), ["s_", "d_"], "left")
    all_ = places.select(n(F.col("name")).alias("n_"), F.col("name").alias("place"), "type", "state_code", "district_code", "ord")
    met = hinted.join(if_small(all_), "n_")
    in_state = F.col("want_state").isNull() | (F.col("state_code") == F.col("want_state"))
    exact = F.coalesce(F.col("district_code") == F.col("want_district"), F.lit(False))
    last = n(F.element_at(F.split("district_code", "-"), -1))
    in_district = (F.col("d_") == "") | exact | (F.col("d_") == last) | (F.col("d_") == n(F.col("district_code")))
    best = met.where(in_state & in_district).groupBy("id").agg(F.min_by(F.struct("place", "type", "state_code", "district_code"), F.struct((~exact).alias("x"), "ord")).alias("b"))
    return requests.join(best, "id", "left").select(*requests.columns, "b.*")


def host_crops(pests: DataFrame, crops: DataFrame) -> DataFrame:
    """(pest_id, crop_id): hosts (a text with ; / , between them) that a crop's name is part of, or that are part of it."""
    each = pests.select("pest_id", F.explode(F.split("hosts", r"\s*[;/,|]\s*")).alias("h")).select("pest_id", F.lower(F.trim("h")).alias("h")).where("h <> ''").distinct()
    names = crops.select("crop_id", F.lower(F.trim("name")).alias("c")).where("c <> ''")
    hosts = each.select("h").distinct().join(if_small(names), F.contains("h", "c") | F.contains("c", "h")).select("h", "crop_id").distinct()
    return each.join(hosts, "h").select("pest_id", "crop_id").distinct()
