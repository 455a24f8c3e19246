"""Texts for a model to answer from: blocks of rows, put together under a token budget, and the two answers made from them.

A context has sections, each a limited read in an order of its own. Under a budget the sections take turns: their first rows, their second
rows, and so on, until the running sum of tokens (a quarter of the UTF-16 length) passes the budget. So no section starves the others, and what is
kept of a section is always its beginning. Contexts are bounded by the reads' limits; nothing here grows with the archive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.functions import text, time
from brainweave.operators import processing

NOTHING_FOUND, NO_ANSWER = "Nothing in the archive matches that query yet.", "No answer generated."
#: Sections of a review in order: name, heading, what stands there if it is empty.
REVIEW = (
    ("events", "CALENDAR OF TODAY", "(no events)"),
    ("tasks", "OPEN TASKS", "(no tasks due soon)"),
    ("mails", "STARRED MAILS", "(no mails waiting)"),
    ("links", "CONNECTIONS OF RECENT ENTRIES", "(no connections)"),
    ("entries", "JOURNAL ENTRIES", "(no entries)"),
)


def _when(condition: Column, *parts) -> Column:
    """The parts as one text if the condition holds, else nothing."""
    return F.coalesce(F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])), F.lit(""))


def _some(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _one_line(c: Column, size: int) -> Column:
    return F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" "))


def entry_block(as_of: Column) -> Column:
    """Of an entry: created_at, channel, summary, tags, primary_type, primary_type_confidence, suggested_actions, full_text.

    The full text stands only in entries of the last day.
    """
    c = {n: F.col(n) for n in ("created_at", "channel", "summary", "tags", "primary_type", "suggested_actions", "full_text")}
    confidence = F.regexp_replace(F.coalesce(F.col("primary_type_confidence").cast("string"), F.lit("null")), r"\.0$", "")
    return F.concat(
        F.lit("=== Entry ["), F.date_format(c["created_at"], "yyyy-MM-dd'T'HH:mm"), F.lit("] ("), c["channel"], F.lit(") ===\n"),
        _when(_some(c["summary"]), "Summary: ", c["summary"], "\n"),
        _when(F.size(c["tags"]) > 0, "Tags: ", F.array_join(c["tags"], ", "), "\n"),
        _when(_some(c["primary_type"]), "Type: ", c["primary_type"], " (confidence: ", confidence, ")\n"),
        _when(c["suggested_actions"].isNotNull(), "Suggested actions: ", F.to_json(c["suggested_actions"]), "\n"),
        _when(c["created_at"] > as_of - F.expr("INTERVAL 1 DAY"), "Full text:\n", c["full_text"], "\n"),
    )


def event_block(zone: str = "UTC") -> Column:
    """Of an event: start_at, end_at, title, location, attendees (name, email; four at most are named), description."""
    clock = lambda c: F.date_format(F.from_utc_timestamp(c, zone), "HH:mm")
    names = F.filter(F.transform("attendees", lambda a: F.coalesce(F.when(a["name"] != "", a["name"]), a["email"])), lambda x: x.isNotNull() & (x != ""))
    return F.concat(
        F.lit("- "), clock("start_at"), F.lit("–"), clock("end_at"), F.lit(" "), F.col("title"), _when(_some(F.col("location")), " (at ", F.col("location"), ")"),
        _when(F.size(names) > 0, " — with ", F.array_join(F.slice(names, 1, 4), ", ")), _when(_some(F.col("description")), "\n  Description: ", _one_line(F.col("description"), 200)),
    )


def task_block(as_of: Column, zone: str = "UTC") -> Column:
    """Of a task: due_at, title, parent_title, list_name, list_type, notes."""
    day, today = (F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd") for c in (F.col("due_at"), as_of))
    due = F.when(F.col("due_at").isNull(), "-").when(day < today, "- [OVERDUE]").when(day == today, "- [TODAY]").otherwise(F.concat(F.lit("- [due "), day, F.lit("]")))
    return F.concat(
        due, F.lit(" "), F.col("title"), _when(_some(F.col("parent_title")), ' (subtask of "', F.col("parent_title"), '")'),
        F.lit(" — list: "), F.coalesce(F.when(F.col("list_name") != "", F.col("list_name")), F.lit("(unfiled)")), _when(_some(F.col("list_type")), " · ", F.col("list_type")),
        _when(_some(F.col("notes")), "\n  Notes: ", _one_line(F.col("notes"), 150)),
    )


def mail_block(zone: str = "UTC") -> Column:
    """Of a mail: sent_at, from_address, subject, snippet."""
    day = F.coalesce(F.date_format(F.from_utc_timestamp("sent_at", zone), "yyyy-MM-dd"), F.lit("?"))
    subject = F.coalesce(F.when(F.col("subject") != "", F.col("subject")), F.lit("(no subject)"))
    return F.concat(F.lit("- ["), day, F.lit("] From "), F.coalesce("from_address", F.lit("null")), F.lit(': "'), subject, F.lit('"'), _when(_some(F.col("snippet")), "\n  ", _one_line(F.col("snippet"), 160)))


def link_block() -> Column:
    """Of a link: entry_at, entry_summary, target_type, target_title, target_date, link_type, confidence, explanation."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    target = F.when(_some(F.col("target_title")), F.concat(F.col("target_type"), F.lit(' "'), F.col("target_title"), F.lit('"'), _when(F.col("target_date").isNotNull(), " (", day("target_date"), ")"))).otherwise(F.col("target_type"))
    summary = F.coalesce(F.when(F.col("entry_summary") != "", F.substring("entry_summary", 1, 120)), F.lit("(no summary)"))
    sure = _when(F.col("confidence").isNotNull() & (F.col("confidence") != 0), " [confidence ", F.format_string("%.2f", F.col("confidence").cast("double")), "]")
    return F.concat(F.lit("- ["), day("entry_at"), F.lit('] Journal: "'), summary, F.lit('" → '), target, F.lit(" ("), F.col("link_type"), F.lit(")"), sure, F.lit("\n  "), F.coalesce("explanation", F.lit("")))


def lines_of(section: str, rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """(section, place, line) of a limited read."""
    return rows.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))


def budgeted(lines: DataFrame, sections: list[str], tokens: int) -> DataFrame:
    """The lines that fit: sections take turns in their order, until the sum of tokens passes the budget."""
    turn = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    upto = F.sum(text.estimate_tokens(F.col("line"))).over(Window.orderBy("place", turn).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_upto", upto).filter(F.col("_upto") <= tokens).drop("_upto")


def assembled(lines: DataFrame, sections, between: dict[str, str]) -> DataFrame:
    """One row ``body``: headings and lines; a section without lines has what stands for it."""
    parts = []
    for name, heading, empty in sections:
        own = F.sort_array(F.collect_list(F.when(F.col("section") == name, F.struct("place", "line"))))
        joined = F.array_join(F.transform(own, lambda x: x["line"]), between.get(name, "\n"))
        parts.append(F.concat(F.lit(f"=== {heading} ===\n"), F.when(F.size(own) > 0, joined).otherwise(F.lit(empty))))
    return lines.agg(F.concat_ws("\n\n", *parts).alias("body"))


def morning_review(
    reads: dict[str, tuple[DataFrame, list[Column]]], model: Callable[[list[str]], list[Any]], as_of: Column, scope: str, zone: str = "UTC", tokens: int = 24_000
) -> DataFrame:
    """(review_date, scope, prompt, content, entry_count): one row, or none where there are no entries, events, tasks and mails.

    reads: rows and their order for each section of REVIEW; model: gives {"content": text} for a prompt.
    """
    blocks = {"events": event_block(zone), "tasks": task_block(as_of, zone), "mails": mail_block(zone), "links": link_block(), "entries": entry_block(as_of)}
    lines = reduce(DataFrame.unionByName, [lines_of(name, *reads[name], blocks[name]) for name, _, _ in REVIEW])
    kept = budgeted(lines, [name for name, _, _ in REVIEW], tokens)
    counted = lines.agg(F.count_if(F.col("section") == "entries").alias("entry_count"), F.count_if(F.col("section") != "links").alias("_n")).filter("_n > 0")
    day = F.date_format(F.from_utc_timestamp(as_of, zone), "yyyy-MM-dd")
    body = assembled(kept, REVIEW, {"entries": "\n---\n\n"})
    prompt = F.concat(F.lit("Today is "), day, F.lit(f" (timezone: {zone}).\n\n"), F.col("body"))
    asked = counted.crossJoin(body).select(day.alias("review_date"), F.lit(scope).alias("scope"), prompt.alias("prompt"), "entry_count")  # one row each
    return processing.ask(asked, F.col("prompt"), model, "content string", "_a", 1).select("review_date", "scope", "prompt", F.col("_a.content").alias("content"), "entry_count")


def ask_archive(found: DataFrame, chunks: DataFrame, query: str, model: Callable[[list[str]], list[Any]], most: int = 1200, sources: int = 5) -> DataFrame:
    """(answer, sources, prompt): one row, from what a search has found.

    found: artifact, chunk (null for an artifact as a whole), score; chunks: artifact, chunk, body, title, summary, published_at (a row per chunk, and one
    with a null chunk per artifact that may be found as a whole). The model, which gives {"answer": text}, isn't asked if nothing was found.
    """
    key = F.col("f.artifact").eqNullSafe(F.col("c.artifact")) & F.col("f.chunk").eqNullSafe(F.col("c.chunk"))
    order = Window.orderBy(F.desc("score"), "artifact", F.col("chunk").asc_nulls_first())
    rows = found.alias("f").join(chunks.alias("c"), key).select("f.artifact", "f.chunk", "score", "title", "published_at", F.coalesce(F.when(F.col("body") != "", F.col("body")), "summary", F.lit("")).alias("excerpt"))
    numbered = rows.withColumn("place", F.row_number().over(order))  # a search's few results
    block = F.concat(F.lit("["), "place", F.lit('] "'), "title", F.lit('" ('), time.iso_day(F.col("published_at")), F.lit(")\n"), F.substring("excerpt", 1, most))
    first = F.row_number().over(Window.partitionBy("artifact").orderBy("place"))
    each = numbered.withColumn("_first", first).select(F.struct("place", block.alias("line"), (F.col("_first") == 1).alias("new"), "title", "published_at").alias("r"))
    listed = each.agg(F.sort_array(F.collect_list("r")).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: r["line"]), "\n\n---\n\n")
    named = F.transform(F.slice(F.filter("rs", lambda r: r["new"]), 1, sources), lambda r: F.struct(r["title"].alias("title"), r["published_at"].alias("published_at")))
    prompt = F.when(F.size("rs") > 0, F.concat(F.lit(f"Question: {query}\n\nExcerpts from the archive:\n\n"), body))
    asked = processing.ask(listed.select(prompt.alias("prompt"), named.alias("sources")), F.col("prompt"), model, "answer string", "_a", 1)
    answer = F.when(F.col("prompt").isNull(), NOTHING_FOUND).otherwise(F.coalesce("_a.answer", F.lit(NO_ANSWER)))
    return asked.select(answer.alias("answer"), "sources", "prompt")
