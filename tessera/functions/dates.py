"""Dates, months and scores that depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order they are tried; day comes before month where both are possible.
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd", "dd MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss")


def parse(x: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp by the first format that fits, or null; never raises."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)) for f in formats])


def iso(ts: Column) -> Column:
    """ISO text; without the time if that is midnight."""
    return F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))


def months(start: Column, end: Column) -> Column:
    """The months from start to end, past December if need be: 10 to 2 is 10, 11, 12, 1, 2."""
    return F.transform(F.sequence(F.lit(0), F.pmod(end - start, F.lit(12))), lambda i: (F.pmod(start - 1 + i, F.lit(12)) + 1).cast("int"))


def months_until(month: Column, wanted: Column) -> Column:
    """Months from one month to the next of some wanted ones, around the year; null if there are none."""
    return F.array_min(F.transform(wanted, lambda h: F.pmod(h - month, F.lit(12)).cast("int")))


def harvest_signal(month: Column, harvest: Column) -> Column:
    """harvest in a harvest month, lean one or two months before one, else transition; unknown without any."""
    away = months_until(month, harvest)
    return F.when(F.coalesce(F.size(harvest), F.lit(0)) <= 0, "unknown").when(away == 0, "harvest").when(away <= 2, "lean").otherwise("transition")


def sow_risk(month: Column, sowing: Column) -> Column:
    """on, near (two months or less to either side), off, or unknown."""
    ahead = months_until(month, sowing)
    behind = F.array_min(F.transform(sowing, lambda h: F.pmod(month - h, F.lit(12)).cast("int")))
    return F.when(F.coalesce(F.size(sowing), F.lit(0)) <= 0, "unknown").when(ahead == 0, "on").when(F.least(ahead, behind) <= 2, "near").otherwise("off")


def freshness(day: Column, today: Column) -> Column:
    """A step function of the age: the future .9, a year .95, three .8, ten .6, else .4; .5 if unknown."""
    age = F.datediff(today, day)
    return F.when(age.isNull(), 0.5).when(age < 0, 0.9).when(age <= 365, 0.95).when(age <= 1095, 0.8).when(age <= 3650, 0.6).otherwise(0.4)
