"""Landing files of the external feeds (JSON, one object per line) as tables with explicit schemas.

Rows without what makes them usable are dropped as the feeds' importers do. Nothing is inferred: a reader takes the
declared fields only, and files can be read as batches or as streams with the same functions.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brainweave.functions import text

TASKS = "id string, title string, notes string, status string, due string, completed string, parent string, position string, listId string, listTitle string"
CONTACTS = "resourceName string, names array<struct<displayName:string>>, emailAddresses array<struct<value:string>>, phoneNumbers array<struct<value:string>>"
EVENTS = (
    "id string, calendarId string, summary string, description string, location string, status string, "
    "start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>, "
    "attendees array<struct<email:string,displayName:string,responseStatus:string>>"
)
MAILS = (
    "id string, threadId string, labelIds array<string>, snippet string, internalDate string, payload string"
)
HEADERS = "headers array<struct<name:string,value:string>>"
VIDEOS = "video_id string, title string, transcript string, keywords string, has_manual_transcript boolean, published_at string, summary string"
MESSAGES = "message_id string, user_id string, channel string, chat_id string, text string, date long"

#: Fixed value: the address of a video by its id. Letters of plain base64 and those of its form for URLs.
VIDEO_URL = "https://youtube.com/watch?v="
URL_LETTERS = str.maketrans("+/", "-_")


def read_json(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def scope_of(source: Column, family_sources: list[str]) -> Column:
    """family for the sources that the configuration names, whatever their case; else personal."""
    names = [s.strip().lower() for s in family_sources]
    return F.when(F.lower(text.strip(source)).isin(*names), "family").otherwise("personal") if names else F.lit("personal")


def tasks(raw: DataFrame, family_lists: list[str]) -> DataFrame:
    return raw.filter("id IS NOT NULL AND title IS NOT NULL AND title != ''").select(
        F.col("id").alias("external_id"), "title", "notes", F.coalesce("status", F.lit("needsAction")).alias("status"),
        F.try_to_timestamp("due").alias("due_at"), F.try_to_timestamp("completed").alias("completed_at"),
        F.col("parent").alias("parent_external_id"), "position", F.col("listId").alias("list_id"), scope_of(F.col("listTitle"), family_lists).alias("scope"),
    )


def contacts(raw: DataFrame) -> DataFrame:
    mail = F.get("emailAddresses", F.lit(0))["value"]
    return raw.filter("resourceName IS NOT NULL").select(
        F.col("resourceName").alias("external_id"),
        F.coalesce(F.get("names", F.lit(0))["displayName"], mail, F.lit("Unknown")).alias("full_name"),
        mail.alias("primary_email"),
        F.get("phoneNumbers", F.lit(0))["value"].alias("primary_phone"),
    )


def instant(when: Column) -> Column:
    """A time, or midnight UTC of a date."""
    return F.coalesce(F.try_to_timestamp(when["dateTime"]), F.try_to_timestamp(when["date"], F.lit("yyyy-MM-dd")))


def events(raw: DataFrame, family_calendars: list[str]) -> DataFrame:
    people = F.transform("attendees", lambda a: F.struct(a["email"].alias("email"), a["displayName"].alias("name"), a["responseStatus"].alias("response")))
    rows = raw.withColumns({"_start": instant(F.col("start")), "_end": instant(F.col("end"))})
    return rows.filter("id IS NOT NULL AND summary IS NOT NULL AND _start IS NOT NULL AND _end IS NOT NULL").select(
        F.col("id").alias("external_id"), F.col("calendarId").alias("calendar_id"), F.col("summary").alias("title"), "description", "location",
        F.col("_start").alias("start_at"), F.col("_end").alias("end_at"), people.alias("attendees"), "status", scope_of(F.col("calendarId"), family_calendars).alias("scope"),
    )


def _plain(part: object) -> str | None:
    """The first text/plain body of a message part, depth first, that isn't empty."""
    open_ = [part]
    while open_:
        now = open_.pop()
        if not isinstance(now, dict):
            continue
        body = now.get("body")
        data = body.get("data") if isinstance(body, dict) else None
        if now.get("mimeType") == "text/plain" and isinstance(data, str):
            letters = re.sub("[^A-Za-z0-9_-]", "", data.translate(URL_LETTERS).split("=")[0])
            text_ = base64.urlsafe_b64decode(letters[: len(letters) - (len(letters) % 4 == 1)] + "==").decode("utf-8", "replace")
            if text_:
                return text_
        parts = now.get("parts")
        open_.extend(reversed(parts if isinstance(parts, list) else []))
    return None


@F.arrow_udf(T.StringType())
def plain_body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text of a message's payload (JSON, parts nested to any depth); null where there is none, or no JSON."""
    for payloads in batches:
        out = []
        for payload in payloads.to_pylist():
            try:
                out.append(_plain(json.loads(payload or "null")))
            except (ValueError, RecursionError):
                out.append(None)
        yield pa.array(out, pa.string())


def header(payload: Column, name: str) -> Column:
    """A header of a message's payload, whatever the name's case; the first if there are several."""
    headers = F.from_json(payload, HEADERS)["headers"]
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def mails(raw: DataFrame, label_names: dict[str, str], family_domains: list[str]) -> DataFrame:
    p = F.col("payload")
    names = F.create_map(*[F.lit(x) for kv in label_names.items() for x in kv]) if label_names else F.lit(None).cast("map<string,string>")
    rows = raw.filter("id IS NOT NULL").select(
        F.col("id").alias("external_id"), F.col("threadId").alias("thread_id"), header(p, "Subject").alias("subject"),
        text.address_of(header(p, "From")).alias("from_address"), text.split_addresses(F.coalesce(header(p, "To"), F.lit(""))).alias("to_addresses"), "snippet",
        plain_body(p).alias("body_text"), F.coalesce("labelIds", F.array().cast("array<string>")).alias("label_ids"),
        F.timestamp_millis(F.col("internalDate").try_cast("long")).alias("sent_at"),
    )
    rows = rows.withColumn("label_names", F.array_compact(F.transform("label_ids", lambda x: F.try_element_at(names, x))))
    return rows.withColumns(
        {
            "is_starred": F.array_contains("label_ids", "STARRED"),
            "is_sent": F.array_contains("label_ids", "SENT"),
            "scope": text.mail_scope(F.col("label_names"), F.col("from_address"), F.col("to_addresses"), family_domains),
        }
    )


def new_mails(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """What isn't stored yet: known mails are skipped, so their flags are never refreshed."""
    return fetched.dropDuplicates(["external_id"]).join(stored.select("external_id"), "external_id", "left_anti")


def videos(raw: DataFrame) -> DataFrame:
    """Transcripts as artifacts; without id, title or transcript a row is dropped, a bad date is null."""
    kind = F.when(F.col("has_manual_transcript"), "manual-transcript").when(~F.col("has_manual_transcript"), "auto-transcript")
    tags = F.array_compact(F.array_append(text.parse_list(F.coalesce("keywords", F.lit(""))), kind))
    return raw.filter("video_id IS NOT NULL AND trim(title) != '' AND trim(transcript) != ''").select(
        F.lit("youtube").alias("source_system"), F.col("video_id").alias("source_external_id"), "title", text.slugify(F.col("title")).alias("slug"),
        F.lit("transcript").alias("type"), F.col("transcript").alias("raw_source"), F.when(F.size(tags) > 0, tags).alias("tags"),
        F.try_to_timestamp("published_at").alias("published_at"), F.concat(F.lit(VIDEO_URL), "video_id").alias("canonical_url"), F.col("summary").alias("source_summary"),
    )


def messages(raw: DataFrame) -> DataFrame:
    """Chat messages as capture events; dates are whole seconds."""
    return raw.filter("text IS NOT NULL").select(
        "message_id", "user_id", "channel", "chat_id", F.col("text").alias("raw_text"), F.timestamp_seconds("date").alias("ts"),
        text.is_new_note(F.col("text")).alias("is_command"), text.is_feedback(F.col("text")).alias("is_feedback"),
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole markdown files with their paths. Files of no bytes give no row: Spark's readers pass them over."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("body"))


def resources(files: DataFrame, scheme: str) -> DataFrame:
    """files (uri, body) as reading matter: (uri, name, mime_type, body), by addresses that don't depend on where the files lie.

    The name is the first heading, or else the file's. ``lookups.by_ids`` reads by address and tells what is unknown.
    """
    file = F.regexp_extract("uri", r"([^/]*?)(\.[^./]*)?$", 1)
    heading = text.strip(F.regexp_extract("body", r"(?m)^#[ \t]+(.+)$", 1))
    kind = F.when(F.col("uri").rlike(r"(?i)\.md$"), "text/markdown").otherwise("text/plain")
    return files.select(
        F.concat(F.lit(f"{scheme}://"), file).alias("uri"), F.when(heading != "", heading).otherwise(file).alias("name"), kind.alias("mime_type"), "body"
    )
