"""The daily review: five scoped, windowed and limited reads, their lines of text, and the review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.functions import text, time
from brainweave.operators import filters, upsert


def recent_entries(entries: DataFrame, as_of: Column, reader: str, days: int = 1, k: int = 200) -> DataFrame:
    own = entries.filter("status = 'processed'").filter(filters.recent(F.col("created_at"), as_of, days))
    return own.filter(filters.visible(F.col("scope"), reader)).orderBy(F.desc("created_at"), "entry_id").limit(k)


def events_of_day(events: DataFrame, as_of: Column, reader: str, zone: str = "UTC") -> DataFrame:
    today = time.local_day(F.col("start_at"), zone) == time.local_day(as_of, zone)
    return events.filter(today & filters.visible(F.col("scope"), reader)).orderBy("start_at", "event_id")


def due_tasks(tasks: DataFrame, as_of: Column, reader: str, days: int = 7, k: int = 40) -> DataFrame:
    """Open tasks due until then or without a date, those without last; with the title of the parent task."""
    parents = tasks.select(F.col("task_id").alias("parent_task_id"), F.col("title").alias("parent_title"))
    soon = filters.at_most_or_null(F.col("due_at"), as_of + F.expr(f"INTERVAL {days} DAYS"))
    own = tasks.filter("status = 'needsAction'").filter(soon).filter(filters.visible(F.col("scope"), reader))
    return own.join(parents, "parent_task_id", "left").orderBy(F.col("due_at").asc_nulls_last(), "task_id").limit(k)


def recent_mails(mails: DataFrame, as_of: Column, reader: str, days: int = 2, k: int = 15) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    own = mails.filter(filters.at_least_or_null(F.col("sent_at"), since)).filter(filters.visible(F.col("scope"), reader))
    return own.orderBy(F.col("sent_at").desc_nulls_last(), "mail_id").limit(k)


def worth_reviewing(*reads: DataFrame) -> bool:
    """Whether any of entries, events, tasks and mails has a row; links alone don't make a review."""
    return any(not df.isEmpty() for df in reads)


def entry_line() -> Column:
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("- "), F.coalesce("summary", text.truncate(F.col("full_text"), 300)), tags)


def task_line(as_of: Column, zone: str = "UTC") -> Column:
    parent = F.when(F.col("parent_title").isNotNull(), F.concat(F.lit(" (under "), F.col("parent_title"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- ["), time.due_label(F.col("due_at"), as_of, zone), F.lit("] "), F.col("title"), parent)


def event_line(zone: str = "UTC") -> Column:
    return F.concat(F.lit("- "), F.date_format(F.from_utc_timestamp("start_at", zone), "HH:mm"), F.lit(" "), F.col("title"))


def save_review(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """By date and scope; a later one replaces content and count."""
    last = upsert.last_per_key(new, ["review_date", "scope"], ["created_at"])
    columns = [c for c in reviews.columns if c not in ("review_date", "scope")]
    return upsert.upsert(reviews, last, ["review_date", "scope"], columns).drop("created")


def section(lines: DataFrame, order: list[str], line: Column, title: str) -> DataFrame:
    """One row: a heading and the lines of a limited read, in order."""
    texts = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return lines.agg(F.concat_ws("\n", F.lit(title), F.array_join(F.transform(texts, lambda x: x["_line"]), "\n")).alias("body"))
