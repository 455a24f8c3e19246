"""Vector functions: cosine distance as a Column, literals, and rounding as the API shows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector, or where sizes differ."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def round_up(x: Column, digits: int) -> Column:
    """x to a number of digits, ties towards plus infinity, as the API's clients round; what has no such digits stays."""
    f = 10.0**digits
    return F.when(F.isnan(x) | (F.abs(x) * f >= 2.0**52), x).otherwise(F.floor(x * f + 0.5) / f)


def similarity(a: Column, b: Column, digits: int | None = None) -> Column:
    s = 1 - cosine_distance(a, b)
    return s if digits is None else round_up(s, digits)


def to_literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_literal(text: Column) -> Column:
    """'[a,b]' as an array of finite doubles; others are dropped, malformed text gives an empty array."""
    body = F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1)
    numbers = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
