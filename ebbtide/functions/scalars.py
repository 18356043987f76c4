"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio whose denominator is at least 1; a missing denominator counts as 1."""
    return numerator / F.greatest(F.lit(1), denominator)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is NULL when the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def is_true(condition: Column) -> Column:
    """Comparison result with missing counted as false."""
    return F.coalesce(condition, F.lit(False))


def rebin(value: Column, bins: Mapping[str, Iterable[str]], other: str) -> Column:
    """Map category members to bin names; anything else, NULL included, goes to ``other``."""
    items = list(bins.items())
    name, members = items[0]
    mapped = F.when(value.isin(*members), F.lit(name))
    for name, members in items[1:]:
        mapped = mapped.when(value.isin(*members), F.lit(name))
    return mapped.otherwise(F.lit(other))


def single_value(value: Column) -> Column:
    """Aggregate: the one value a group holds, or ``*`` if it holds several."""
    return F.when(F.min(value) == F.max(value), F.min(value)).when(F.count(value) > 0, F.lit("*"))
