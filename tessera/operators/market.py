"""Price series: trends, statistics, robust baselines and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions.numbers import half_up, percent, stable_sum


def price_trend(prices: DataFrame, keys: list[str], price: str, low: str, high: str, order: list[str]) -> DataFrame:
    """By key: rows, mean, least, most, range, and the latest price and date; ties at the date go by the rest of the order.

    One shuffle on the key, with partial sums; the latest row is a maximum of structs, so no window is needed.
    """
    latest = F.max(F.struct(*order, F.col(price).alias("value_")))
    out = prices.groupBy(*keys).agg(F.count("*").alias("n_days"), (stable_sum(F.col(price)) / F.count(price)).alias("mean"), F.min(low).alias("min_price"), F.max(high).alias("max_price"), latest.alias("latest"))
    return out.select(*keys, "n_days", half_up(F.col("mean"), 2).alias("avg_modal"), half_up(F.col("min_price"), 2).alias("min_price"), half_up(F.col("max_price"), 2).alias("max_price"), half_up(F.col("max_price") - F.col("min_price"), 2).alias("price_range"), half_up(F.col(f"latest.value_"), 2).alias("latest_modal"), F.col(f"latest.{order[0]}").alias("latest_date"))


def price_stats(prices: DataFrame, keys: list[str], price: str, order: list[str]) -> DataFrame:
    """By key: n, latest, mean, least, most, spread and volatility (population) in per cent of the mean, and the trend.

    The trend compares first and last price: rising or falling beyond one per cent, else flat.
    """
    x = F.col(price)
    ends = prices.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        (stable_sum(x) / F.count("*")).alias("m"),
        (stable_sum(x * x) / F.count("*")).alias("sq"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.min(F.struct(*order, F.col(price).alias("value_"))).alias("first"),
        F.max(F.struct(*order, F.col(price).alias("value_"))).alias("last"),
    )
    change = F.try_divide(F.col(f"last.value_") - F.col(f"first.value_"), F.col(f"first.value_"))
    return ends.select(
        *keys,
        "n",
        half_up(F.col(f"last.value_"), 2).alias("latest"),
        half_up(F.col("m"), 2).alias("mean"),
        half_up(F.col("low"), 2).alias("min"),
        half_up(F.col("high"), 2).alias("max"),
        half_up(F.try_divide(F.col("high") - F.col("low"), F.col("m")) * 100.0, 1).alias("spread_pct"),
        half_up(F.try_divide(F.sqrt(F.greatest(F.col("sq") - F.col("m") * F.col("m"), F.lit(0.0))), F.col("m")) * 100.0, 1).alias("volatility_pct"),
        F.when(F.col("n") < 2, "flat").when(change > 0.01, "rising").when(change < -0.01, "falling").otherwise("flat").alias("trend"),
        F.col(f"last.{order[0]}").alias("latest_date"),
    )


def robust_stats(rows: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Median and median absolute deviation of the positive values of each key with at least so many."""
    good = rows.where(F.col(value) > 0).select(*keys, value)
    middle = good.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    return good.join(middle, keys).groupBy(*keys, "median", "n").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def outliers(rows: DataFrame, stats: DataFrame, keys: list[str], value: str, times: float = 5.0) -> DataFrame:
    """Rows further from their key's median than so many deviations; keys without any deviation flag nothing."""
    both = rows.join(stats.select(*keys, "median", "mad"), keys)
    return both.where((F.col("mad") > 0) & (F.abs(F.col(value) - F.col("median")) / F.col("mad") > times))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; Spark cuts the rows before the shuffle (window group limit)."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def day_over_day(rows: DataFrame, keys: list[str], order: list[str], price: str) -> DataFrame:
    """Each price with the one before it and the change in per cent."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("prev_price", F.lag(price).over(w)).withColumn("change_pct", percent(F.col(price), F.col("prev_price")))


def against_floor(rows: DataFrame, price: str, floor: str) -> DataFrame:
    """above, below or at a support price, by half a per cent of the rounded difference."""
    off = percent(F.col(price), F.col(floor))
    return rows.withColumn("floor_pct", off).withColumn("floor_label", F.when(off.isNull(), "unknown").when(off > 0.5, "above").when(off < -0.5, "below").otherwise("at"))


def of_commodity(rows: DataFrame, wanted: str, columns: list[str], market: str | None = None, market_column: str = "market") -> DataFrame:
    """Rows in which any of the columns is the wanted name, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.lower(c) == wanted.lower())
    rows = rows.where(hit)
    return rows.where(F.lower(market_column) == market.lower()) if market else rows


def soft_filter(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, or all of them if none does; one plan, no driver round trip."""
    flagged = rows.withColumn("hit_", F.coalesce(condition, F.lit(False)))
    anything = flagged.agg(F.coalesce(F.bool_or("hit_"), F.lit(False)).alias("any_"))
    return flagged.where(F.col("hit_") | ~anything.scalar()).drop("hit_")


def with_signal(stats: DataFrame, month: Column, harvest: Column) -> DataFrame:
    return stats.withColumn("season_signal", dates.harvest_signal(month, harvest))
