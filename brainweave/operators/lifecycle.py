"""Time-driven states of drafts, suggestions, queues and cycles. All depend on ``as_of``, never on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.functions import text, time
from brainweave.operators import graph, upsert

DRAFT_IDLE, SUGGESTION_LIFE = 300, 86_400


def confirm_idle_drafts(entries: DataFrame, as_of: Column, idle: int = DRAFT_IDLE) -> DataFrame:
    """Drafts strictly longer idle than five minutes are pending; their window ends far enough back to be processed at once."""
    old = (F.col("status") == "drafting") & time.older_than(F.col("updated_at"), idle, as_of)
    return upsert.set_where(entries, old, status="pending", window_end=as_of - F.expr("INTERVAL 11 MINUTES"), updated_at=as_of)


def settle_drafts(entries: DataFrame, signals: DataFrame) -> DataFrame:
    """signals: entry_id, signal (done or cancel), ts. The first one counts, and only for entries still in draft."""
    first = upsert.first_per_key(signals.select("entry_id", "ts", "signal"), ["entry_id"], ["ts"])
    to = F.when(F.col("signal") == "done", "pending").otherwise("cancelled")
    new = first.select("entry_id", to.alias("status"), F.col("ts").alias("updated_at"))
    return upsert.update_from(entries, new, "entry_id", ["status", "updated_at"], F.col("status") == "drafting")


def append_to_drafts(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """messages: entry_id, ts, message_id, body. Texts are appended, in time order, to entries still in draft."""
    texts = F.sort_array(F.collect_list(F.struct("ts", "message_id", "body")))
    new = messages.groupBy("entry_id").agg(F.array_join(F.transform(texts, lambda m: m["body"]), "\n").alias("_more"), F.max("ts").alias("_at"))
    open_ = F.col("_more").isNotNull() & (F.col("status") == "drafting")
    return (
        entries.join(new, "entry_id", "left")
        .withColumn("full_text", F.when(open_, F.concat_ws("\n", "full_text", "_more")).otherwise(F.col("full_text")))
        .withColumn("updated_at", F.when(open_, F.col("_at")).otherwise(F.col("updated_at")))
        .select(*entries.columns)
    )


def expire_suggestions(suggestions: DataFrame, as_of: Column, life: int = SUGGESTION_LIFE) -> DataFrame:
    """Pending suggestions that were posted strictly more than a day ago are expired."""
    old = (F.col("status") == "pending") & time.older_than(F.col("posted_at"), life, as_of)
    return upsert.set_where(suggestions, F.coalesce(old, F.lit(False)), status="expired", resolved_at=as_of)


def resolve_suggestions(suggestions: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: suggestion_id, ts, outcome (added, skipped). The first answer to a pending one counts; later ones lose."""
    first = upsert.first_per_key(answers.select("suggestion_id", "ts", "outcome"), ["suggestion_id"], ["ts"])
    new = first.select("suggestion_id", F.col("outcome").alias("status"), F.col("ts").alias("resolved_at"))
    return upsert.update_from(suggestions, new, "suggestion_id", ["status", "resolved_at"], F.col("status") == "pending")


def next_to_post(suggestions: DataFrame, k: int = 10) -> DataFrame:
    return suggestions.filter("status = 'pending' AND posted_at IS NULL").orderBy("created_at", "suggestion_id").limit(k)


def mark_posted(suggestions: DataFrame, posts: DataFrame) -> DataFrame:
    """posts: suggestion_id, ts, message_id. The first post of a suggestion is noted, once; later ones, also those of later batches, change nothing."""
    first = upsert.first_per_key(posts.select("suggestion_id", "ts", "message_id"), ["suggestion_id"], ["ts", "message_id"])
    new = first.select("suggestion_id", F.col("ts").alias("posted_at"), "message_id")
    return upsert.update_from(suggestions, new, "suggestion_id", ["posted_at", "message_id"], F.col("posted_at").isNull())


#: Fixed value: the classifier's type of entries that may be tasks.
TASK = "task_candidate"


def suggest_tasks(entries: DataFrame, captures: DataFrame, lists: dict[str, str], threshold: float = 0.6) -> DataFrame:
    """Suggestions for processed entries that may be tasks, whose confidence reaches the threshold: one per entry, none without a title.

    captures: entry_id, chat_id, received_at; a suggestion goes to its entry's own chat, else to the latest that it was captured in.
    """
    confidence = F.coalesce("primary_type_confidence", F.lit(0.0))
    sure = entries.filter((F.col("primary_type") == TASK) & (confidence >= threshold))
    chats = captures.filter("chat_id IS NOT NULL").groupBy("entry_id").agg(F.max_by("chat_id", F.struct("received_at", "chat_id")).alias("chat"))
    name = F.lit(None).cast("string")
    for scope, title in lists.items():
        name = F.when(F.col("scope") == scope, title).otherwise(name)
    return sure.join(chats, "entry_id", "left").select(
        "entry_id", "scope", text.suggested_title(F.col("suggested_actions"), F.col("summary"), F.col("clean_text")).alias("suggested_title"),
        name.alias("list_name"), F.coalesce("chat_id", "chat").alias("chat_id"), F.lit("pending").alias("status"),
    ).filter("suggested_title != ''")


def cooled_down(df: DataFrame, as_of: Column) -> DataFrame:
    """Open amendments with allowed (as_of has reached cooldown_until) and seconds_left, the longest waiting first."""
    return (
        df.filter("status = 'proposed'")
        .withColumn("allowed", as_of >= F.col("cooldown_until"))
        .withColumn("seconds_left", time.seconds_left(F.col("cooldown_until"), as_of))
        .orderBy("proposed_at", "amendment_id")
    )


def founding(amendments: DataFrame, first: int = 5) -> DataFrame:
    """amendments with bypass: whether fewer than five of kind new were committed before, per user and in time order.

    Each task keeps the first five of a user before anything is shuffled (a limit pushed into the window), and these five meet the amendments by id:
    a user with a third of all rows is spread over tasks throughout. Ids are unique.
    """
    order = Window.partitionBy("user_id").orderBy("committed_at", "amendment_id")
    new = amendments.filter("kind = 'new'").select("amendment_id", "user_id", "committed_at")
    early = new.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).select("amendment_id", F.lit(True).alias("_early"))
    return amendments.join(early, "amendment_id", "left").select(*amendments.columns, F.coalesce("_early", F.lit(False)).alias("bypass"))


def over_cap(goals: DataFrame, cap: int = 3) -> DataFrame:
    """Per user and domain: active goals, and whether another one is refused."""
    return goals.groupBy("user_id", "domain_id").agg(F.count_if(F.col("status") == "active").alias("active")).withColumn("full", F.col("active") >= cap)


def open_cycles(undertakings: DataFrame, cycles: DataFrame, day: Column, days: int = 28) -> DataFrame:
    """The next cycle of each active habit without an active one: number, start and end date."""
    past = cycles.groupBy("undertaking_id").agg(F.max("cycle_number").alias("last"), F.count_if(F.col("status") == "active").alias("active"))
    return (
        undertakings.filter("kind = 'habit_forming' AND status = 'active'")
        .join(past, "undertaking_id", "left")
        .filter(F.coalesce("active", F.lit(0)) == 0)
        .select("undertaking_id", (F.coalesce("last", F.lit(0)) + 1).alias("cycle_number"), day.alias("start_date"), F.date_add(day, days).alias("end_date"), F.lit("active").alias("status"))
    )


def close_cycles(cycles: DataFrame, closing: DataFrame) -> DataFrame:
    """closing: cycle_id, closed_at, streak_summary, reformulation_notes. What is left out (null) stays."""
    new = closing.select("cycle_id", "closed_at", F.col("streak_summary").alias("_s"), F.col("reformulation_notes").alias("_r"))
    joined = cycles.drop("closed_at").join(new.withColumn("_hit", F.lit(True)), "cycle_id", "left")
    hit = F.col("_hit") & (F.col("status") == "active")
    return joined.select(
        *[
            {
                "status": F.when(hit, "closed").otherwise(F.col("status")),
                "streak_summary": F.when(hit, F.coalesce("_s", "streak_summary")).otherwise(F.col("streak_summary")),
                "reformulation_notes": F.when(hit, F.coalesce("_r", "reformulation_notes")).otherwise(F.col("reformulation_notes")),
                "closed_at": F.when(hit, F.col("closed_at")),
            }.get(c, F.col(c)).alias(c)
            for c in cycles.columns
        ]
    )


def claim(queue: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The oldest pending rows, to be worked on by one batch."""
    return queue.filter("status = 'pending'").orderBy("created_at", key).limit(k)


def latest_draft(entries: DataFrame) -> DataFrame:
    """The draft of each user and chat that was touched last."""
    return graph.first_per(entries.filter("status = 'drafting'"), ["user_id", "chat_id"], [F.desc("updated_at"), F.col("entry_id")])


def claimed(queue: DataFrame, key: str, as_of: Column, k: int = 1) -> DataFrame:
    """The queue after one batch has claimed its oldest pending rows: they are in processing, and no later batch sees them."""
    heads = claim(queue, key, k).select(key, F.lit("processing").alias("status"), as_of.alias("updated_at"))
    return upsert.update_from(queue, heads, key, ["status", "updated_at"], F.col("status") == "pending")


def mark_errors(rows: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """errors: key, ts, message. Rows that failed are in error, with the last message of each."""
    last = upsert.last_per_key(errors.select(key, "ts", "message"), [key], ["ts", "message"])
    return upsert.update_from(rows, last.select(key, F.lit("error").alias("status"), F.col("message").alias("last_error")), key, ["status", "last_error"])


def daily_runs(ticks: DataFrame, schedules: list[tuple[str, str, str]]) -> DataFrame:
    """(label, day, ts): of ticks (ts) the first in the minute of each schedule (label, HH:mm, zone), once per local date."""
    each = [F.struct(F.lit(label).alias("label"), (time.local_minute(F.col("ts"), zone) == at).alias("due"), time.local_day(F.col("ts"), zone).alias("day")) for label, at, zone in schedules]
    return ticks.select("ts", F.inline(F.array(*each))).filter("due").groupBy("label", "day").agg(F.min("ts").alias("ts"))
