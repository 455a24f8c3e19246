"""Counts and diagnostics of the archive; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.functions import time


def count_by(df: DataFrame, key: str) -> DataFrame:
    """(key, n), the most frequent first, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(key).asc_nulls_last())


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """One row: total and one count per state."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == s).alias(s) for s in ("processed", "pending", "processing", "error")],
    )


def slow(df: DataFrame, seconds: int = 600) -> DataFrame:
    """One row: how many took strictly longer between created_at and updated_at."""
    took = time.seconds_between(F.col("created_at"), F.col("updated_at"))
    return df.agg(F.count_if(took > seconds).alias("slow"))


def oldest_pending(df: DataFrame, as_of: Column, key: str, k: int = 10) -> DataFrame:
    age = time.seconds_between(F.col("created_at"), as_of).alias("age_seconds")
    return df.filter("status = 'pending'").select(key, "created_at", age).orderBy("created_at", key).limit(k)


def newest_processed(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    took = time.seconds_between(F.col("created_at"), F.col("updated_at")).alias("seconds")
    return df.filter("status = 'processed'").select(key, "updated_at", took).orderBy(F.desc("updated_at"), key).limit(k)


def next_number(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, next): one more than the largest number, 1 where there is none."""
    return df.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def tag_concentration(df: DataFrame, tags: str, weight: str) -> DataFrame:
    """(tag, n, share, mean_weight): how entries spread over tags."""
    rows = df.select(F.explode(tags).alias("tag"), F.col(weight).alias("w"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_weight"))
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", F.try_divide("n", "total").alias("share"), "mean_weight")  # one row
