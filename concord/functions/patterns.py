"""Patterns of rule programs in Java's dialect, and quantities in text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern for Spark (named groups made plain, word classes in Unicode) and the index of each named group."""
    index = dict(re.compile(pattern).groupindex)
    return "(?U)" + re.sub(r"\(\?P<\w+>", "(", pattern), index


#: Amounts of substance per litre in nanomolar; both micro signs.
MOLAR = {"M": 1e9, "mM": 1e6, "uM": 1e3, "µM": 1e3, "μM": 1e3, "nM": 1.0, "pM": 1e-3}


def parse_quantity(text: Column, units: dict[str, float] = MOLAR, extra: str = "") -> Column:
    """Array of (amount, unit, value in the canonical unit) of every number with a unit in the text."""
    names = "|".join(sorted(map(re.escape, units), key=len, reverse=True))
    pattern = rf"(?<![\p{{L}}\p{{N}}.])(\d+(?:\.\d+)?)\s*({names})(?![\p{{L}}\p{{N}}]){extra}"
    table = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    numbers, found = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(numbers, found, lambda n, u: F.struct(n.cast("double").alias("amount"), u.alias("unit"),
        (n.cast("double") * F.element_at(table, u)).alias("value")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
