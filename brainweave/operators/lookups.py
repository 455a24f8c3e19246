"""Lookups by name, time and filters that answer a question about one thing: people, events, tasks, mails, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.operators import filters, graph


def find_people(people: DataFrame, name: str, k: int = 10) -> DataFrame:
    """People whose name or mail address holds the text: exact names first, then beginnings, then the rest."""
    q = name.strip().lower()
    low = F.lower("full_name")
    rank = F.when(low == q, 1).when(low.startswith(q), 2).when(low.contains(q), 3).when(F.lower("primary_email").contains(q), 4)
    return people.withColumn("match", rank).filter("match IS NOT NULL").orderBy("match", "full_name", "person_id").limit(k)


def events_between(events: DataFrame, start: Column, end: Column, reader: str) -> DataFrame:
    """Events that overlap the interval [start, end]: those that begin before its end and end at its start or later."""
    return events.filter((F.col("start_at") < end) & (F.col("end_at") >= start) & filters.visible(F.col("scope"), reader)).orderBy("start_at", "event_id")


def list_tasks(tasks: DataFrame, status: str | None, due_before, scopes: list[str] | None, k: int = 50) -> DataFrame:
    where = filters.all_of(
        None if status is None else F.col("status") == status, None if due_before is None else F.col("due_at") <= due_before, filters.one_of(F.col("scope"), scopes)
    )
    return tasks.filter(where).orderBy(F.col("due_at").asc_nulls_last(), "task_id").limit(k)


def search_mails(mails: DataFrame, words: list[str], sender: str | None, since, k: int = 20) -> DataFrame:
    """Mails that hold any of the words in subject, snippet or body, best first."""
    columns = [F.col("subject"), F.col("snippet"), F.col("body_text")]
    where = filters.all_of(
        filters.contains_any(columns, words) if words else None,
        None if sender is None else F.contains(F.lower("from_address"), F.lit(sender.lower())),
        filters.between(F.col("sent_at"), low=since),
    )
    score = filters.keyword_score(columns, words) if words else F.lit(0)
    return mails.filter(where).withColumn("score", score).orderBy(F.desc("score"), F.col("sent_at").desc_nulls_last(), "mail_id").limit(k)


def search_artifacts(hits: DataFrame, k: int = 10, over: int = 3) -> DataFrame:
    """Of the k * over best chunks (artifact, chunk, similarity) the best one of each artifact, k at most."""
    pool = hits.orderBy(F.desc("similarity"), "chunk").limit(k * over)
    return graph.first_per(pool, ["artifact"], [F.desc("similarity"), F.col("chunk")]).orderBy(F.desc("similarity"), "artifact").limit(k)


def by_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row for every wanted key (key), with the columns of df and ``found``; without a row of df they are null. Keys of df are unique."""
    return wanted.select(key).distinct().join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lists_named(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name) with list_id, that of the list (list_id, title) of this name whatever its case, the smallest of several; null for none."""
    ids = lists.groupBy(F.lower("title").alias("_name")).agg(F.min("list_id").alias("list_id"))
    return wanted.join(ids, F.lower("name") == F.col("_name"), "left").drop("_name")
