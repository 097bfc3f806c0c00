"""Predicates built from data: rule checks, confidence bands and filter specifications."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence bands.
HIGH, MEDIUM, LOW = 0.9, 0.7, 0.5


def confidence_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def in_band(col: Column, level: str) -> Column:
    value = confidence_of(col)
    if level == "any":
        return F.lit(True)
    if level == "high":
        return value >= HIGH
    if level == "medium":
        return (value >= MEDIUM) & (value < HIGH)
    if level == "low":
        return value < MEDIUM
    raise ValueError(f"unknown confidence level {level!r}")


def band_of(col: Column, high: float = HIGH, medium: float = MEDIUM, low: float = LOW) -> Column:
    value = confidence_of(col)
    return (
        F.when(value >= high, "high")
        .when(value >= medium, "medium")
        .when(value >= low, "low")
        .otherwise("very-low")
    )


def matches_pattern(pattern: str, is_regex: bool, upper_value: Column) -> Column:
    """Plain text: equality without case; regex: match of the whole upper-cased value."""
    if is_regex:
        return upper_value.rlike(rf"\A(?:{pattern})\z")
    return upper_value == pattern.upper()


def not_empty(col: Column) -> Column:
    return F.length(F.trim(col)) > 0


def positive(col: Column) -> Column:
    return col > 0


def non_negative(col: Column) -> Column:
    return col >= 0


def in_range(col: Column, low: Any, high: Any) -> Column:
    return col.between(low, high)


def full_match(col: Column, pattern: str) -> Column:
    return col.cast("string").rlike(rf"\A(?:{pattern})\z")


def one_of(col: Column, values: list[Any]) -> Column:
    return col.isin(values)


_OPERATORS = {
    "=": lambda c, v: c.eqNullSafe(v),
    "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not-in": lambda c, v: ~c.isin(list(v)) | c.isNull(),
    "between": lambda c, v: c.between(v[0], v[1]),
    "matches": full_match,
    "not": lambda c, v: ~c.eqNullSafe(v),
    "nil": lambda c, _: c.isNull(),
    "not-nil": lambda c, _: c.isNotNull(),
    "contains": lambda c, v: c.contains(v),
    "starts-with": lambda c, v: c.startswith(v),
    "ends-with": lambda c, v: c.endswith(v),
}


def constraint(column: Column, spec: Any) -> Column:
    """One field constraint: a bare value, or ``(operator, argument)``."""
    if isinstance(spec, (tuple, list)):
        name, argument = spec[0], spec[1] if len(spec) > 1 else None
        if name not in _OPERATORS:
            raise ValueError(f"unknown filter operator {name!r}")
        return _OPERATORS[name](column, argument)
    return _OPERATORS["="](column, spec)


def all_of(filters: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [constraint(F.col(f), s) for f, s in filters.items()], F.lit(True))
