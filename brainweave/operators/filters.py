"""Predicates of the reads, as Columns to be pushed into scans. ``None`` for an optional value means no predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conditions given, joined by AND; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def one_of(column: Column, values: list | None) -> Column | None:
    return None if values is None else column.isin(*values)


def between(column: Column, low=None, high=None) -> Column | None:
    """Inclusive bounds, either of which may be missing."""
    return all_of(None if low is None else column >= low, None if high is None else column <= high)


def any_tag(tags: Column, wanted: list[str] | None) -> Column | None:
    return None if not wanted else F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def all_tags(tags: Column, wanted: list[str] | None) -> Column | None:
    return None if not wanted else F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def at_least_or_null(column: Column, low) -> Column:
    return column.isNull() | (column >= low)


def at_most_or_null(column: Column, high) -> Column:
    return column.isNull() | (column <= high)


def contains_any(columns: list[Column], words: list[str]) -> Column:
    """Whether a word stands in any of the columns, whatever its case; null columns count as without."""
    return reduce(lambda a, b: a | b, [hit(columns, w) for w in words], F.lit(False))


def hit(columns: list[Column], word: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False)) for c in columns], F.lit(False))


def keyword_score(columns: list[Column], words: list[str]) -> Column:
    """How many of the words stand in any of the columns."""
    return reduce(lambda a, b: a + b, [hit(columns, w).cast("int") for w in words], F.lit(0))


def recent(ts: Column, as_of: Column, days: int, inclusive: bool = False) -> Column:
    """In the trailing window; without its first instant, unless inclusive."""
    edge = as_of - F.expr(f"INTERVAL {days} DAYS")
    return ts >= edge if inclusive else ts > edge


def visible(scope: Column, reader: str) -> Column:
    """Personal readers see both scopes, family readers only their own."""
    return F.lit(True) if reader == "personal" else scope == "family"


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none: not found is an empty result."""
    return df.filter(F.col(key) == F.lit(value))
