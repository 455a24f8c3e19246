"""Stitching of messages, in batch and as a stream, and counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.operators import stitch
from brainweave.plans import roles
from brainweave.sources import sinks
from brainweave.sources.tables import table
from brainweave.streaming import capture, late


def _stitched(spark: SparkSession, sf: str, gap: int, feedback: bool = False) -> DataFrame:
    return stitch.entries(roles.captures(spark, sf, feedback), gap).drop("channel")


def stitch_10_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return _stitched(spark, sf, 600)


def stitch_6_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _stitched(spark, sf, 21_600)


def stitch_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return _stitched(spark, sf, 86_400, feedback=True)


def stitched_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the texts of their messages (their types), in time order."""
    found = stitch.entries(roles.captures(spark, sf), 21_600, body=F.col("event_type"))
    return found.select("user_id", "entry_no", "messages", F.md5("full_text").alias("digest"))


def ready_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that are idle long enough at the present."""
    found = _stitched(spark, sf, 21_600).withColumn("status", F.lit("pending")).withColumn("channel", F.lit("chat"))
    return stitch.ready(found, roles.as_of()).select("user_id", "entry_no", "window_end")


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).alias("hour"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of files."""
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events*.parquet")
    return stream.select(
        "user_id", F.lit("chat").alias("channel"), "ts", F.col("event_id").alias("message_id"), (F.col("event_type") == "signup").alias("is_command"), F.lit(False).alias("is_feedback"), "event_type"
    )


def _drained(spark: SparkSession, stream: DataFrame, schema: str) -> DataFrame:
    work = sinks.scratch(spark, "stream")
    capture.drain(stream, f"{work}/checkpoint", sinks.append_batch(f"{work}/out"))
    return spark.read.schema(schema).parquet(f"{work}/out")


def stitch_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stream form of stitch_6_hours: entries that are closed when the stream has been read."""
    found = _drained(spark, capture.stitch_stream(_events_stream(spark, sf), 21_600), capture.OUT)
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "messages")


def stitch_late(spark: SparkSession, sf: str) -> DataFrame:
    """stitch_6_hours from a stream in which messages arrive out of order, in four micro-batches by a hash of their ids."""
    work = sinks.scratch(spark, "late")
    part = F.pmod(F.xxhash64("message_id"), F.lit(4)).cast("int")
    arriving = roles.captures(spark, sf).select("*", part.alias("part"), (F.timestamp_seconds(1_800_000_000 + part * 3600)).alias("arrived"))
    schema = arriving.drop("part").schema
    arriving.repartition(4, "part").write.partitionBy("part").parquet(f"{work}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in/part=*")
    with late.rocksdb(spark):
        found = _drained(spark, late.stitch_versions(stream, 21_600), late.OUT)
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return late.latest(found).select("user_id", *ends, "messages")


def hourly_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour that the watermark has passed when the stream has been read."""
    counted = capture.hourly_counts(_events_stream(spark, sf)).select(F.col("window.start").alias("hour"), "event_type", "n")
    found = _drained(spark, counted, "hour timestamp, event_type string, n long")
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def _sql(gap: int, select: str, feedback: str = "FALSE") -> str:
    return f"""WITH m AS (SELECT event_id, user_id, ts, event_type, {feedback} AS fb FROM events WHERE event_type <> 'signup'),
c AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'),
p AS (SELECT *, lag(ts) OVER w AS prev, lag(fb) OVER w AS pfb FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT p.*, (SELECT max(c.ts) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts) AS cmd FROM p),
s AS (SELECT *, (prev IS NULL OR fb OR pfb OR ts - prev >= INTERVAL {gap} SECOND OR coalesce(cmd > prev, FALSE))::INT AS new FROM q),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS entry_no FROM s)
{select}"""


_ROWS = "SELECT user_id, entry_no, min(ts) AS window_start, max(ts) AS window_end, count(*) AS messages FROM n GROUP BY user_id, entry_no"

QUERIES = {
    "stitch_10_minutes": (stitch_10_minutes, _sql(600, _ROWS)),
    "stitch_6_hours": (stitch_6_hours, _sql(21_600, _ROWS)),
    "stitch_with_feedback": (stitch_with_feedback, _sql(86_400, _ROWS, "event_type = 'error'")),
    "stitched_texts": (
        stitched_texts,
        _sql(21_600, "SELECT user_id, entry_no, count(*) AS messages, md5(string_agg(event_type, chr(10) ORDER BY ts, event_id)) AS digest FROM n GROUP BY user_id, entry_no"),
    ),
    "ready_entries": (
        ready_entries,
        _sql(21_600, f"SELECT user_id, entry_no, max(ts) AS window_end FROM n GROUP BY user_id, entry_no HAVING max(ts) < TIMESTAMP '{roles.AS_OF}' - INTERVAL 600 SECOND"),
    ),
    "stitch_stream": (
        stitch_stream,
        _sql(
            21_600,
            """, e AS (SELECT user_id, entry_no, min(ts) AS window_start, max(ts) AS window_end, count(*) AS messages, max(entry_no) OVER (PARTITION BY user_id) AS last FROM n GROUP BY user_id, entry_no)
SELECT user_id, window_start, window_end, messages FROM e WHERE entry_no < last OR window_end + INTERVAL 21600 SECOND < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
        ),
    ),
    "stitch_late": (stitch_late, _sql(21_600, "SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS messages FROM n GROUP BY user_id, entry_no")),
    "hourly_stream": (
        hourly_stream,
        """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events
           WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    ),
    "hourly_events": (
        hourly_events,
        "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
}
