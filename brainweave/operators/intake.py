"""Appends of what comes in: sessions, chat messages and drafts, as new rows of entries and captures.

Ids follow from the content (a hash), not from a random generator, so that a job that is run again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.functions import text
from brainweave.operators import upsert


def new_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256)


def save_sessions(sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """sessions (title, summary, scope, labels) as entries and their capture events.

    The window lies 15 minutes back, so that the entry can be processed at once; the event has the default scope.
    """
    back = as_of - F.expr("INTERVAL 15 MINUTES")
    body = text.session_text(F.col("title"), F.col("summary"), F.coalesce("labels", F.array().cast("array<string>")))
    entries = sessions.select(
        new_id("title", "summary").alias("entry_id"), body.alias("full_text"), F.lit("session").alias("channel"), as_of.alias("created_at"),
        back.alias("window_start"), back.alias("window_end"), F.coalesce("scope", F.lit("personal")).alias("scope"), F.lit("pending").alias("status"),
    )
    events = entries.select(F.col("entry_id").alias("message_id"), "entry_id", "channel", F.col("full_text").alias("raw_text"), as_of.alias("received_at"), F.lit("personal").alias("scope"), F.lit(False).alias("is_command"))
    return entries, events


def family_messages(messages: DataFrame, members: DataFrame, trigger: str) -> DataFrame:
    """Messages of members (user_id) that begin with the trigger or come from a member's own chat, without the marked spans.

    messages: user_id, chat_id, raw_text, spans (array of start, size).
    """
    known = messages.join(F.broadcast(members.select("user_id").distinct()), "user_id", "left_semi")  # a household's members
    own = F.col("chat_id") == F.col("user_id").cast("string")
    meant = own | F.lower(F.ltrim("raw_text")).startswith(trigger.lower())
    return known.filter(meant).withColumn("raw_text", text.without_spans(F.col("raw_text"), F.col("spans")))


def reader_scopes(messages: DataFrame, owner) -> DataFrame:
    """messages with reader: the owner's own chat may see both scopes, every other one the family's."""
    own = (F.col("user_id") == owner) & (F.col("chat_id") == F.col("user_id").cast("string"))
    return messages.withColumn("reader", F.when(own, "personal").otherwise("family"))


def new_drafts(messages: DataFrame) -> DataFrame:
    """One draft per message that opens one."""
    return messages.select(
        new_id("user_id", "chat_id", "message_id").alias("entry_id"), "user_id", "chat_id", F.col("raw_text").alias("full_text"), F.lit("family").alias("scope"),
        F.lit("drafting").alias("status"), *[F.col("ts").alias(c) for c in ("created_at", "updated_at", "window_start", "window_end")],
    )


def reply_text(answer: Column, sources: Column, most: int = 4000) -> Column:
    """An answer with its list of sources, cut to what a message takes."""
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n")))
    whole = F.concat(answer, F.coalesce(listed, F.lit("")))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 15), F.lit("…"))).otherwise(whole)


def link_episodes(picks: DataFrame, links: DataFrame) -> DataFrame:
    """Editorial picks (pick_id, ..., episode_url, episode_linked_at) after links (pick_id, ts, episode_url): the last of each pick stays."""
    last = upsert.last_per_key(links.select("pick_id", "ts", "episode_url"), ["pick_id"], ["ts", "episode_url"])
    new = last.select("pick_id", "episode_url", F.col("ts").alias("episode_linked_at"))
    return upsert.update_from(picks, new, "pick_id", ["episode_url", "episode_linked_at"])
