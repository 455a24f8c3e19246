"""The daily review, its parts and its text; and answers over mail and notes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.operators import briefing, graph, review, search
from brainweave.plans import roles
from brainweave.sources import sinks
from brainweave.sources.tables import table

PRESENT = roles.ORDERS_AS_OF


def review_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = review.recent_entries(roles.entries(spark, sf).withColumn("status", F.lit("processed")), roles.as_of(PRESENT), "personal", days=30)
    return found.select("entry_id", "created_at", "scope")


def review_entries_family(spark: SparkSession, sf: str) -> DataFrame:
    found = review.recent_entries(roles.entries(spark, sf), roles.as_of(PRESENT), "family", days=400)
    return found.select("entry_id", "created_at", "scope")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    t = roles.tasks(spark, sf)
    return t.filter("due_at IS NOT NULL").select(F.col("task_id").alias("event_id"), "title", (F.col("due_at") + F.expr("INTERVAL 20 HOURS")).cast("timestamp").alias("start_at"), "scope")


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the local day, which begins at another instant than the UTC day."""
    found = review.events_of_day(_events(spark, sf), roles.as_of(PRESENT), "personal", "Asia/Hong_Kong")
    return found.select("event_id", "title", F.col("start_at").cast("timestamp_ntz").alias("start_at"))


def review_tasks(spark: SparkSession, sf: str) -> DataFrame:
    found = review.due_tasks(roles.tasks(spark, sf), roles.as_of(PRESENT), "personal", days=7)
    return found.select("task_id", "due_at", "parent_title", review.task_line(roles.as_of(PRESENT)).alias("line"))


def review_mails(spark: SparkSession, sf: str) -> DataFrame:
    mails = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("mail_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("sent_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "family").otherwise("personal").alias("scope")
    )
    return review.recent_mails(mails, roles.as_of(PRESENT), "family").select("mail_id", "sent_at")


def review_section(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks of a review as one text."""
    due = review.due_tasks(roles.tasks(spark, sf), roles.as_of(PRESENT), "family", days=7)
    return review.section(due, ["task_id"], review.task_line(roles.as_of(PRESENT)), "Tasks")


def saved_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """One review per day and scope: the last order of a day wins over what was there."""
    o = table(spark, sf, "orders")
    scope = F.when(F.col("o_orderpriority") == "1-URGENT", "family").otherwise("personal")
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_date"), scope.alias("scope"), F.col("o_orderkey").alias("created_at"), F.col("o_orderstatus").alias("content"), F.col("o_totalprice").alias("entry_count"))
    old = graph.first_per(rows.filter("content = 'F'"), ["review_date", "scope"], [F.col("created_at")])
    return review.save_review(old, rows.filter("content != 'F'"))


def rss_feed(spark: SparkSession, sf: str) -> DataFrame:
    r = saved_reviews(spark, sf).select("review_date", "scope", F.concat(F.lit("<p>"), "content", F.lit("</p>")).alias("content_html"))
    return sinks.rss(r.filter("scope = 'personal'"), "Review & notes", "https://feed.example")


def digests(texts: list[str]) -> list[dict]:
    """A stand-in for a model: what it says is the MD5 of what it is shown."""
    return [{"content": d, "answer": d} for d in (hashlib.md5(t.encode()).hexdigest() for t in texts)]


def morning_review(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as entries and tasks, events, suppliers as mails, customers as links: five limited reads under a budget of 400 tokens."""
    none = F.lit(None).cast("array<struct<kind:string>>")
    o = table(spark, sf, "orders")
    entries = o.filter(F.col("o_orderdate") <= roles.as_of(PRESENT)).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(12)
    entries = entries.select(
        "o_orderkey", F.col("o_orderdate").alias("created_at"), F.lit("chat").alias("channel"), F.col("o_orderpriority").alias("summary"), F.array("o_orderstatus").alias("tags"),
        F.lit("idea").alias("primary_type"), F.lit(0.8).alias("primary_type_confidence"), none.alias("suggested_actions"), F.col("o_orderpriority").alias("full_text"),
    )
    tasks = o.filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(8).select(
        "o_orderkey", F.col("o_orderdate").alias("due_at"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("parent_title"),
        F.when(F.col("o_custkey") % 2 == 0, "Do").alias("list_name"), F.when(F.col("o_custkey") % 2 == 0, "do").alias("list_type"), F.when(F.col("o_custkey") % 5 == 0, "a\nb").alias("notes"),
    )
    people = F.array(F.struct(F.lit("x@y.example").alias("email"), F.col("event_type").alias("name")))
    events = table(spark, sf, "events").orderBy("event_id").limit(5).select(
        "event_id", F.col("ts").cast("timestamp").alias("start_at"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).cast("timestamp").alias("end_at"), F.col("event_type").alias("title"),
        F.when(F.col("event_id") % 2 == 0, "here").alias("location"), people.alias("attendees"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("description"),
    )
    mails = table(spark, sf, "supplier").orderBy("s_suppkey").limit(6).select(
        "s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.lit("1998-06-14 01:00:00").cast("timestamp_ntz")).alias("sent_at"), F.col("s_name").alias("from_address"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nation "), "s_nationkey")).alias("subject"), F.when(F.col("s_suppkey") % 4 > 0, "seen").alias("snippet"),
    )
    links = table(spark, sf, "customer").orderBy("c_custkey").limit(6).select(
        "c_custkey", F.lit("1998-06-13 00:00:00").cast("timestamp_ntz").alias("entry_at"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("entry_summary"), F.lit("person").alias("target_type"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("target_title"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1998-01-02").cast("date")).alias("target_date"), F.lit("mentions_person").alias("link_type"),
        F.when(F.col("c_custkey") % 5 > 0, F.lit(0.75)).alias("confidence"), F.col("c_mktsegment").alias("explanation"),
    )
    reads = {
        "entries": (entries, [F.desc("created_at"), F.col("o_orderkey")]), "tasks": (tasks, [F.col("o_orderkey")]), "events": (events, [F.col("event_id")]), "mails": (mails, [F.col("s_suppkey")]),
        "links": (links, [F.col("c_custkey")]),
    }
    return briefing.morning_review(reads, digests, roles.as_of(PRESENT), "family", tokens=400)


def ask_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The five longest documents as what a search found, and the answer from their excerpts."""
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    found = d.select(F.col("source").alias("artifact"), F.col("doc_id").alias("chunk"), F.col("n_chars").cast("double").alias("score"))
    day = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-03-01").cast("date"))
    chunks = d.select(F.col("source").alias("artifact"), F.col("doc_id").alias("chunk"), F.col("text").alias("body"), F.upper("source").alias("title"), F.lit("").alias("summary"), day.alias("published_at"))
    answer = briefing.ask_archive(found, chunks, "What is here?", digests)
    return answer.select("answer", F.array_join(F.transform("sources", lambda s: s["title"]), ",").alias("sources"), F.length("prompt").alias("n_chars"))


def answer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts of two retrievers over documents and one over parts, numbered."""
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    docs = d.select(F.lit("entry").alias("kind"), F.col("doc_id").alias("key"), F.substring("text", 1, 500).alias("body"))
    p = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)
    parts = p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("body"))
    return search.numbered_blocks([docs, parts], ["kind", "key"])


_TASKS = """t AS (SELECT o_orderkey AS task_id, o_orderpriority || ' ' || o_orderstatus AS title, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS due_at,
  min(o_orderkey) OVER (PARTITION BY o_custkey) AS parent, CASE WHEN o_orderpriority = '1-URGENT' THEN 'family' ELSE 'personal' END AS scope FROM orders)"""
_DAY = PRESENT[:10]


def _due_sql(where: str) -> str:
    return f"""WITH {_TASKS}, u AS (SELECT t.*, p.title AS parent_title FROM t LEFT JOIN t p ON p.task_id = t.parent
  WHERE t.o_orderstatus <> 'F' AND (t.due_at IS NULL OR t.due_at <= TIMESTAMP '{PRESENT}' + INTERVAL 7 DAY) AND {where} ORDER BY t.due_at NULLS LAST, t.task_id LIMIT 40),
v AS (SELECT *, '- [' || CASE WHEN due_at IS NULL THEN 'no date' WHEN due_at::DATE < DATE '{_DAY}' THEN 'OVERDUE' WHEN due_at::DATE = DATE '{_DAY}' THEN 'TODAY' ELSE strftime(due_at, '%Y-%m-%d') END
  || '] ' || title || CASE WHEN parent_title IS NULL THEN '' ELSE ' (under ' || parent_title || ')' END AS line FROM u)"""


_SAVED = """r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS review_date, CASE WHEN o_orderpriority = '1-URGENT' THEN 'family' ELSE 'personal' END AS scope, o_orderkey AS created_at, o_orderstatus AS content, o_totalprice AS entry_count FROM orders),
old AS (SELECT * FROM r WHERE content = 'F' QUALIFY row_number() OVER (PARTITION BY review_date, scope ORDER BY created_at) = 1),
new AS (SELECT * FROM r WHERE content <> 'F' QUALIFY row_number() OVER (PARTITION BY review_date, scope ORDER BY created_at DESC) = 1),
saved AS (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (review_date, scope))"""

_BRIEF = f"""WITH e AS (SELECT 'JOURNAL ENTRIES' AS h, 5 AS turn, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place,
  '=== Entry [' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') || '] (chat) ===' || chr(10) || 'Summary: ' || o_orderpriority || chr(10) || 'Tags: ' || o_orderstatus || chr(10) || 'Type: idea (confidence: 0.8)' || chr(10)
    || CASE WHEN o_orderdate > TIMESTAMP '{PRESENT}' - INTERVAL 1 DAY THEN 'Full text:' || chr(10) || o_orderpriority || chr(10) ELSE '' END AS line
  FROM orders WHERE o_orderdate <= TIMESTAMP '{PRESENT}' QUALIFY place <= 12),
t AS (SELECT 'OPEN TASKS' AS h, 2 AS turn, row_number() OVER (ORDER BY o_orderkey) AS place,
  CASE WHEN o_orderdate::DATE < DATE '{_DAY}' THEN '- [OVERDUE]' WHEN o_orderdate::DATE = DATE '{_DAY}' THEN '- [TODAY]' ELSE '- [due ' || strftime(o_orderdate, '%Y-%m-%d') || ']' END || ' order ' || o_orderkey
    || CASE WHEN o_custkey % 3 = 0 THEN ' (subtask of "' || o_orderpriority || '")' ELSE '' END || ' — list: ' || CASE WHEN o_custkey % 2 = 0 THEN 'Do · do' ELSE '(unfiled)' END
    || CASE WHEN o_custkey % 5 = 0 THEN chr(10) || '  Notes: a b' ELSE '' END AS line FROM orders WHERE o_orderstatus = 'O' QUALIFY place <= 8),
v AS (SELECT 'CALENDAR OF TODAY' AS h, 1 AS turn, row_number() OVER (ORDER BY event_id) AS place,
  '- ' || strftime(ts, '%H:%M') || '–' || strftime(ts + INTERVAL 30 MINUTE, '%H:%M') || ' ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' (at here)' ELSE '' END || ' — with ' || event_type
    || CASE WHEN event_id % 3 = 0 AND props <> '' THEN chr(10) || '  Description: ' || replace(left(props, 200), chr(10), ' ') ELSE '' END AS line FROM events QUALIFY place <= 5),
m AS (SELECT 'STARRED MAILS' AS h, 3 AS turn, row_number() OVER (ORDER BY s_suppkey) AS place,
  '- [' || CASE WHEN s_suppkey % 3 > 0 THEN '1998-06-14' ELSE '?' END || '] From ' || s_name || ': "' || CASE WHEN s_suppkey % 2 = 0 THEN 'nation ' || s_nationkey ELSE '(no subject)' END || '"'
    || CASE WHEN s_suppkey % 4 > 0 THEN chr(10) || '  seen' ELSE '' END AS line FROM supplier QUALIFY place <= 6),
k AS (SELECT 'CONNECTIONS OF RECENT ENTRIES' AS h, 4 AS turn, row_number() OVER (ORDER BY c_custkey) AS place,
  '- [1998-06-13] Journal: "' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '(no summary)' END || '" → person' || CASE WHEN c_custkey % 3 > 0 THEN ' "' || c_name || '"' || CASE WHEN c_custkey % 4 = 0 THEN ' (1998-01-02)' ELSE '' END ELSE '' END
    || ' (mentions_person)' || CASE WHEN c_custkey % 5 > 0 THEN ' [confidence 0.75]' ELSE '' END || chr(10) || '  ' || c_mktsegment AS line FROM customer QUALIFY place <= 6),
every AS (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM v UNION ALL SELECT * FROM m UNION ALL SELECT * FROM k),
kept AS (SELECT *, sum(ceil(length(line) / 4)) OVER (ORDER BY place, turn) AS upto FROM every QUALIFY upto <= 400),
s AS (SELECT turn, '=== ' || h || ' ===' || chr(10) || CASE WHEN turn = 5 THEN array_to_string(list(line ORDER BY place), chr(10) || '---' || chr(10) || chr(10)) ELSE array_to_string(list(line ORDER BY place), chr(10)) END AS body FROM kept GROUP BY turn, h),
p AS (SELECT 'Today is {_DAY} (timezone: UTC).' || chr(10) || chr(10) || array_to_string(list(body ORDER BY turn), chr(10) || chr(10)) AS prompt FROM s)
SELECT '{_DAY}' AS review_date, 'family' AS scope, prompt, md5(prompt) AS content, (SELECT count(*) FROM e) AS entry_count FROM p"""

QUERIES = {
    "morning_review": (morning_review, _BRIEF),
    "ask_answer": (
        ask_answer,
        """WITH d AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, source, doc_id) AS place FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)),
        p AS (SELECT 'Question: What is here?' || chr(10) || chr(10) || 'Excerpts from the archive:' || chr(10) || chr(10) || array_to_string(list('[' || place || '] "' || upper(source) || '" ('
          || CASE WHEN doc_id % 2 = 0 THEN '2024-03-01' ELSE 'undated' END || ')' || chr(10) || left(text, 1200) ORDER BY place), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS prompt FROM d),
        f AS (SELECT source, min(place) AS place FROM d GROUP BY source)
        SELECT md5(prompt) AS answer, (SELECT string_agg(upper(source), ',' ORDER BY place) FROM f) AS sources, length(prompt)::INT AS n_chars FROM p""",
    ),
    "review_entries": (
        review_entries,
        f"""SELECT o_orderkey AS entry_id, o_orderdate AS created_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'family' ELSE 'personal' END AS scope FROM orders
        WHERE o_orderdate > TIMESTAMP '{PRESENT}' - INTERVAL 30 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""",
    ),
    "review_entries_family": (
        review_entries_family,
        f"""SELECT o_orderkey AS entry_id, o_orderdate AS created_at, 'family' AS scope FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '{PRESENT}' - INTERVAL 400 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""",
    ),
    "review_events": (
        review_events,
        f"""SELECT o_orderkey AS event_id, o_orderpriority || ' ' || o_orderstatus AS title, o_orderdate + INTERVAL 20 HOUR AS start_at FROM orders
        WHERE o_orderpriority <> '5-LOW' AND (o_orderdate + INTERVAL 28 HOUR)::DATE = (TIMESTAMP '{PRESENT}' + INTERVAL 8 HOUR)::DATE""",
    ),
    "review_tasks": (review_tasks, _due_sql("TRUE") + " SELECT task_id, due_at, parent_title, line FROM v"),
    "review_mails": (
        review_mails,
        f"""WITH m AS (SELECT o_orderkey AS mail_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS sent_at FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT * FROM m WHERE sent_at IS NULL OR sent_at >= TIMESTAMP '{PRESENT}' - INTERVAL 2 DAY ORDER BY sent_at DESC NULLS LAST, mail_id LIMIT 15""",
    ),
    "review_section": (review_section, _due_sql("t.scope = 'family'") + " SELECT 'Tasks' || chr(10) || string_agg(line, chr(10) ORDER BY task_id) AS body FROM v"),
    "saved_reviews": (saved_reviews, f"WITH {_SAVED} SELECT * FROM saved"),
    "rss_feed": (
        rss_feed,
        f"""WITH {_SAVED}, l AS (SELECT * FROM saved WHERE scope = 'personal' ORDER BY review_date DESC LIMIT 20)
        SELECT '<?xml version="1.0"?><rss version="2.0"><channel><title>Review &amp; notes</title><link>https://feed.example</link>' || string_agg(
          '<item><title>Review &amp; notes ' || review_date || '</title><guid>https://feed.example/' || review_date || '</guid><description><![CDATA[<p>' || content || '</p>]]></description></item>', '' ORDER BY review_date DESC)
          || '</channel></rss>' AS xml FROM l""",
    ),
    "answer_blocks": (
        answer_blocks,
        """WITH d AS (SELECT 'entry' AS kind, doc_id AS key, left(text, 500) AS body FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5),
        p AS (SELECT 'part' AS kind, p_partkey AS key, p_name AS body FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5)
        SELECT *, row_number() OVER (ORDER BY kind, key)::INT AS number FROM (SELECT * FROM d UNION ALL SELECT * FROM p)""",
    ),
}
