"""Stitching: messages of a user and channel become one entry as long as less than ten minutes lie between neighbours.

A gap of exactly the limit splits. A boundary command splits if it stands after the last message, not in the same instant. A
feedback message is an entry of its own, and what follows within its instant or later is a new one.

A user may hold a third of all messages, so no window spans a user's whole history: messages are looked at within days,
and what a day needs of the days before - the last message and the number of entries - comes from a table with one row
per user, channel and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user_id", "channel"]


def stitched(messages: DataFrame, gap_seconds: int = 600, order: str = "message_id") -> DataFrame:
    """messages (user_id, channel, ts, is_command, is_feedback, ``order``) without commands, with entry_no from 1 per user and channel."""
    at = F.col("ts").cast("timestamp")
    rows = messages.withColumn("_us", F.unix_micros(at)).withColumn("_day", F.to_date(at))
    rows = rows.withColumn("_rank", F.struct(F.col("_us"), F.when(F.col("is_command"), 0).otherwise(1).alias("c"), F.col(order).alias("o")))
    # what the days before leave: the last message's time, whether it was feedback, and the last command's time
    said = lambda c: F.when(~F.col("is_command"), c)
    days = rows.groupBy(*KEY, "_day").agg(
        F.max(said(F.struct("_rank", F.col("is_feedback").alias("f")))).alias("last"),
        F.max(F.when(F.col("is_command"), F.col("_us"))).alias("command"),
    )
    before = Window.partitionBy(*KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        *KEY, "_day", F.max("last").over(before).alias("_day_last"), F.max("command").over(before).alias("_day_command")
    )
    in_day = Window.partitionBy(*KEY, "_day").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_last", F.max(said(F.struct("_rank", F.col("is_feedback").alias("f")))).over(in_day))
        .withColumn("_command", F.max(F.when(F.col("is_command"), F.col("_us"))).over(in_day))
        .join(carried, [*KEY, "_day"])
        .withColumn("_last", F.coalesce("_last", "_day_last"))
        .withColumn("_command", F.greatest("_command", "_day_command"))
        .filter(~F.col("is_command"))
    )
    end = F.col("_last._rank._us")
    starts = (
        F.col("_last").isNull()
        | F.col("is_feedback")
        | F.col("_last.f")
        | (F.col("_us") - end >= gap_seconds * 1_000_000)
        | F.coalesce(F.col("_command") > end, F.lit(False))
    )
    rows = rows.withColumn("_new", starts.cast("int"))
    opened = rows.groupBy(*KEY, "_day").agg(F.sum("_new").alias("_n"))
    opened = opened.select(*KEY, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_opened"))
    return (
        rows.withColumn("_in_day", F.sum("_new").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
        .join(opened, [*KEY, "_day"])
        .withColumn("entry_no", (F.col("_opened") + F.col("_in_day")).cast("long"))
        .select(*messages.columns, "entry_no")
    )


def entries(messages: DataFrame, gap_seconds: int = 600, order: str = "message_id", body: Column | None = None) -> DataFrame:
    """One row per entry: first and last time, messages and, if body is given, the texts joined by newlines in time order."""
    found = stitched(messages, gap_seconds, order)
    aggs = [F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count(F.lit(1)).alias("messages")]
    if body is not None:
        texts = F.sort_array(F.collect_list(F.struct("ts", F.col(order).alias("o"), body.alias("t"))))
        aggs.append(F.array_join(F.transform(texts, lambda x: x["t"]), "\n").alias("full_text"))
    return found.groupBy(*KEY, "entry_no").agg(*aggs)


def ready(entries: DataFrame, as_of: Column, idle_seconds: int = 600) -> DataFrame:
    """Entries that may be processed: pending, and strictly longer without a message than the gap; oldest first."""
    idle = F.col("window_end") < as_of - F.expr(f"INTERVAL {idle_seconds} SECONDS")
    return entries.filter((F.col("status") == "pending") & idle).orderBy("window_end", *KEY)
