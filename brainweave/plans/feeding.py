"""Queries over what feeds and classifiers bring in: mail bodies, videos, chat texts, task suggestions, entities of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import text
from brainweave.operators import lifecycle, processing
from brainweave.sources import feeds
from brainweave.sources.tables import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def mail_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """documents as mails with pictures and attachments: the body stands three parts deep, after an empty one; every fifth has none."""
    part = lambda kind, data: F.struct(F.lit(kind).alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    coded = F.translate(F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), r"[\r\n=]", ""), "+/", "-_")
    inner = F.array(part("text/html", coded), part("text/plain", F.lit("")), F.when(F.col("doc_id") % 5 > 0, part("text/plain", coded)))
    nest = lambda kind, parts: F.struct(F.lit(kind).alias("mimeType"), parts.alias("parts"))
    payload = F.to_json(nest("multipart/mixed", F.array(nest("multipart/related", F.array(nest("multipart/alternative", F.array_compact(inner)))))))
    mails = _documents(spark, sf).select(F.col("doc_id").alias("mail_id"), feeds.plain_body(payload).alias("body"))
    return mails.select("mail_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


def imported_videos(spark: SparkSession, sf: str) -> DataFrame:
    """documents as transcripts, with keywords, of which a third was written by hand and a third by a machine."""
    known = F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 == 0)
    raw = _documents(spark, sf).select(
        F.concat(F.lit("v"), "doc_id").alias("video_id"), F.concat_ws(" ", F.lit("Talk:"), "lang", "source").alias("title"), F.col("text").alias("transcript"),
        F.concat_ws("; ", F.upper("lang"), "source").alias("keywords"), known.alias("has_manual_transcript"), F.lit("2024-02-30").alias("published_at"), F.col("lang").alias("summary"),
    )
    found = feeds.videos(raw)
    return found.select("source_external_id", "type", "title", "slug", F.array_join("tags", ",").alias("tags"), "published_at", "canonical_url", "source_summary", F.md5("raw_source").alias("digest"))


def stripped_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chat messages that begin with a face and a mention: spans count UTF-16 units, white space becomes one blank."""
    said = F.concat(F.lit("\U0001f600@bot\n "), F.coalesce("text", F.lit("")))
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("size")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("size")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.without_spans(said, spans).alias("said"))
    return rows.select("conv_id", "turn", F.length("said").alias("n_chars"), F.md5("said").alias("digest"))


def suggested_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as classified entries, turns of conversations as the chats they came from."""
    action = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    d = F.col("doc_id")
    reasons = F.array(action("task", F.lit(" ")), action("note", F.lit("n")), action("task", F.concat(F.lit(" Ask "), "source", F.lit(" "))))
    entries = _documents(spark, sf).select(
        d.alias("entry_id"), F.when(d % 3 < 2, "task_candidate").otherwise("task").alias("primary_type"), F.when(d % 7 > 0, (d % 10) / 10).alias("primary_type_confidence"),
        F.when(F.col("lang") == "en", "family").otherwise("personal").alias("scope"), F.when(d % 4 == 0, F.concat(F.lit("own"), d)).alias("chat_id"),
        F.when(d % 5 == 0, F.lit("  ")).when(d % 5 == 1, F.concat(F.lit(" About "), "source")).alias("summary"), F.col("text").alias("clean_text"),
        F.when(d % 2 == 0, reasons).alias("suggested_actions"),
    )
    chats = table(spark, sf, "conversations").select(F.col("conv_id").alias("entry_id"), F.when(F.col("role") != "system", F.concat("role", F.lit(":"), "turn")).alias("chat_id"), F.col("turn").alias("received_at"))
    found = lifecycle.suggest_tasks(entries, chats, {"family": "Family", "personal": "Do"})
    return found.select("entry_id", "scope", F.md5("suggested_title").alias("title"), "list_name", "chat_id", "status")


def entities_of_users(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as mentions of entities by users: the last name and aliases stay, the first orders' entities are known before."""
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 11).alias("user_id"), F.col("o_orderstatus").alias("entity_type"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit(" "))).otherwise(F.col("o_orderpriority")).alias("display_name"),
        F.array(F.col("o_custkey").cast("string")).alias("aliases"),
    )
    known = rows.filter("seq < 500").withColumn("normalized_name", F.lower(F.trim("display_name")))
    current = known.groupBy("user_id", "entity_type", "normalized_name").agg(F.max_by(F.struct("display_name", "aliases", "seq"), "seq").alias("e"))
    found = processing.upsert_entities(current.select("user_id", "entity_type", "normalized_name", "e.*"), rows.filter("seq >= 500"))
    return found.select("user_id", "entity_type", "normalized_name", "display_name", F.array_join("aliases", ",").alias("aliases"), "seq", "created")


QUERIES = {
    "mail_bodies": (
        mail_bodies,
        """SELECT doc_id AS mail_id, length(b)::INT AS n_chars, md5(b) AS digest
           FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN nullif(text, '') END AS b FROM documents)""",
    ),
    "imported_videos": (
        imported_videos,
        r"""WITH t AS (SELECT *, concat_ws(' ', 'Talk:', lang, source) AS title, concat_ws('; ', upper(lang), source) AS words FROM documents WHERE trim(text) <> '')
           SELECT 'v' || doc_id AS source_external_id, 'transcript' AS type, title, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 120) AS slug,
             array_to_string(list_filter(list_transform(string_split(words, ';'), lambda x: lower(trim(x))), lambda x: x <> '')
               || CASE doc_id % 3 WHEN 0 THEN ['manual-transcript'] WHEN 1 THEN ['auto-transcript'] ELSE [] END, ',') AS tags,
             NULL::TIMESTAMP AS published_at, 'https://youtube.com/watch?v=v' || doc_id AS canonical_url, lang AS source_summary, md5(text) AS digest FROM t""",
    ),
    "stripped_messages": (
        stripped_messages,
        r"""SELECT conv_id, turn, length(s)::INT AS n_chars, md5(s) AS digest FROM (SELECT conv_id, turn,
             trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS s FROM conversations)""",
    ),
    "suggested_tasks": (
        suggested_tasks,
        """WITH c AS (SELECT conv_id, arg_max(role || ':' || turn, (turn, role || ':' || turn)) AS chat FROM conversations WHERE role <> 'system' GROUP BY conv_id),
           e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Ask ' || source WHEN doc_id % 5 = 1 THEN 'About ' || source ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS t
             FROM documents WHERE doc_id % 3 < 2 AND CASE WHEN doc_id % 7 > 0 THEN (doc_id % 10) / 10 ELSE 0 END >= 0.6)
           SELECT doc_id AS entry_id, CASE WHEN lang = 'en' THEN 'family' ELSE 'personal' END AS scope, md5(CASE WHEN length(t) > 200 THEN left(t, 199) || '…' ELSE t END) AS title,
             CASE WHEN lang = 'en' THEN 'Family' ELSE 'Do' END AS list_name, CASE WHEN doc_id % 4 = 0 THEN 'own' || doc_id ELSE chat END AS chat_id, 'pending' AS status
           FROM e LEFT JOIN c ON conv_id = doc_id WHERE t <> ''""",
    ),
    "entities_of_users": (
        entities_of_users,
        """WITH r AS (SELECT o_custkey % 11 AS user_id, o_orderstatus AS entity_type, lower(o_orderpriority) AS normalized_name, o_orderkey AS seq,
             CASE WHEN o_orderkey % 2 = 0 THEN ' ' || upper(o_orderpriority) || ' ' ELSE o_orderpriority END AS display_name, o_custkey::VARCHAR AS aliases FROM orders)
           SELECT user_id, entity_type, normalized_name, arg_max(display_name, seq) AS display_name, arg_max(aliases, seq) AS aliases, max(seq) AS seq, min(seq) >= 500 AS created
           FROM r GROUP BY ALL""",
    ),
}
