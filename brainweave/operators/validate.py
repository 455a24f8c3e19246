"""Integrity rules as reads: every function returns the rows or keys that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null in them are distinct."""
    known = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break rules, with their names in ``errors``. A rule that is null for a row isn't broken by it."""
    errors = F.array_compact(F.array(*[F.when(~c, name) for name, c in rules.items()]))
    return df.withColumn("errors", errors).filter(F.size("errors") > 0)


def merged_rule() -> Column:
    """Merged rows, and no others, say into which row."""
    return (F.col("status") == "merged") == F.col("merged_into_id").isNotNull()


def more_than(df: DataFrame, keys: list[str], condition: Column, most: int) -> DataFrame:
    """Keys with more than ``most`` rows for which the condition holds."""
    return df.groupBy(*keys).agg(F.count_if(condition).alias("n")).filter(F.col("n") > most)


def text_rule(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def date_rule(column: str) -> Column:
    return F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$")


def uuid_rule(column: str) -> Column:
    return F.col(column).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
