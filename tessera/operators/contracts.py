"""Contracts: declared fields, what rows break of them, and how a discovered schema differs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upstream names of the contract's types.
TYPE_NAMES = {"keyword": "str", "text": "str", "string": "str", "varchar": "str", "double": "float", "decimal": "float", "number": "float", "long": "int", "integer": "int", "bigint": "int", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    required: bool = False
    low: float | None = None
    high: float | None = None
    one_of: tuple[str, ...] = ()
    date_format: str | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()
    filterable: tuple[str, ...] = ()
    volume: tuple[int, int] | None = field(default=None)

    def digest(self) -> str:
        """The same for contracts that ask the same of their source."""
        said = {"fields": sorted((f.name, f.type, f.date_format or "", f.required) for f in self.fields), "filterable": sorted(self.filterable), "key": list(self.key)}
        return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def problems(self) -> Column:
        """array<string>, one for each thing that a row breaks."""
        out: list[Column] = []
        for f in self.fields:
            c = F.col(f.name)
            text = c.cast("string")
            missing = c.isNull() | (F.trim(text) == "")
            if f.required:
                out.append(F.when(missing, f"{f.name}: required"))
            if f.type in ("int", "float"):
                number = text.try_cast("double")
                out.append(F.when(~missing & number.isNull(), f"{f.name}: not a number"))
                if f.low is not None:
                    out.append(F.when(number < f.low, f"{f.name}: below {f.low:g}"))
                if f.high is not None:
                    out.append(F.when(number > f.high, f"{f.name}: above {f.high:g}"))
            if f.one_of:
                out.append(F.when(~missing & ~c.isin(*f.one_of), f"{f.name}: not allowed"))
            if f.date_format:
                out.append(F.when(~missing & F.try_to_timestamp(text, F.lit(f.date_format)).isNull(), f"{f.name}: not a date"))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")

    def unexpected(self, columns: list[str]) -> list[str]:
        """Columns that aren't declared, nor raw copies, nor marks of redaction."""
        known = {f.name for f in self.fields}
        return sorted(c for c in columns if c not in known and not c.endswith("_raw") and not c.startswith("pii_"))


def same_type(x: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in TYPE_NAMES.items() for v in pair])
    return F.coalesce(names[F.lower(x)], F.lower(x))


def drift(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(field, change) between two tables (field, type, filterable): added, removed, type_changed, no_longer_filterable."""
    a = declared.select("field", same_type(F.col("type")).alias("a_type"), F.col("filterable").alias("a_filter"))
    b = found.select("field", same_type(F.col("type")).alias("b_type"), F.col("filterable").alias("b_filter"))
    both = a.join(b, "field", "full_outer")
    change = F.when(F.col("a_type").isNull(), "added").when(F.col("b_type").isNull(), "removed").when(F.col("a_type") != F.col("b_type"), "type_changed").when(F.col("a_filter") & ~F.col("b_filter"), "no_longer_filterable")
    return both.select("field", change.alias("change")).where("change is not null")
