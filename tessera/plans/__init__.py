"""Operators bound to tables, by name."""

from tessera.plans import answers, governance, lake, prices, rules, texts  # noqa: F401
