"""Rounding, shares and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    """Half up, as floor(x * 10**places + 0.5); the same in any engine, unlike round on binary fractions."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def percent(a: Column, b: Column, places: int = 1) -> Column:
    """How much a is over b, in per cent; null if b is null or zero."""
    return half_up(F.try_divide(a - b, b) * 100.0, places)


def lenient(x: Column) -> Column:
    """A number, or null for anything else; thousands separators are dropped."""
    return F.expr("cast(null as double)") if x is None else F.regexp_replace(F.trim(x.cast("string")), ",", "").try_cast("double")


def exact_sum(x: Column, places: int = 4) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(x.cast(f"decimal(28,{places})"))


def stable_sum(x: Column, places: int = 4) -> Column:
    """As exact_sum for computed fractions: each value is brought to whole units first, half up, as a double in the end."""
    scale = float(10**places)
    return F.sum(F.floor(x * scale + 0.5).cast("decimal(38,0)")).cast("double") / scale


def quintal_to_tonne(x: Column) -> Column:
    """A price for a tenth of a tonne as a price for a tonne."""
    return half_up(x * 10.0, 2)


def hectogram_to_kilogram(x: Column) -> Column:
    return half_up(x / 10.0, 3)


def acre_to_hectare(x: Column) -> Column:
    return half_up(x / 2.471053814671653, 4)
