import datetime as dt
import random

import pytest

from brainweave.operators import stitch
from brainweave.sources import sinks
from brainweave.streaming import capture
from pyspark.sql import functions as F

SCHEMA = "user_id long, channel string, ts timestamp_ntz, is_command boolean, is_feedback boolean, message_id long"
T = dt.datetime(2024, 1, 1, 23, 55)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def say(user, seconds, n, command=False, feedback=False, channel="c"):
    return (user, channel, at(seconds), command, feedback, n)


def replay(rows, gap=600):
    """The archive's way: one message after the other."""
    out, state = {}, {}
    for u, ch, ts, command, feedback, n in sorted(rows, key=lambda r: (r[2], not r[3], r[5])):
        s = state.setdefault((u, ch), {"end": None, "commands": [], "entry": 0, "alone": False})
        if command:
            s["commands"].append(ts)
            continue
        joins = s["end"] is not None and not feedback and not s["alone"] and s["end"] > ts - dt.timedelta(seconds=gap) and not any(c > s["end"] for c in s["commands"])
        s["entry"] += 0 if joins else 1
        s["end"], s["alone"] = ts, feedback
        out[n] = s["entry"]
    return out


CASES = {
    "9:59 joins": ([say(1, 0, 1), say(1, 599, 2)], {1: 1, 2: 1}),
    "10:00 splits": ([say(1, 0, 1), say(1, 600, 2)], {1: 1, 2: 2}),
    "10:01 splits": ([say(1, 0, 1), say(1, 601, 2)], {1: 1, 2: 2}),
    "other user or channel": ([say(1, 0, 1), say(2, 1, 2), say(1, 2, 3, channel="d")], {1: 1, 2: 1, 3: 1}),
    "command between": ([say(1, 0, 1), say(1, 10, 2, command=True), say(1, 20, 3)], {1: 1, 3: 2}),
    "command in the same instant": ([say(1, 0, 1), say(1, 0, 2, command=True), say(1, 20, 3)], {1: 1, 3: 1}),
    "feedback stands alone": ([say(1, 0, 1), say(1, 10, 2, feedback=True), say(1, 20, 3), say(1, 30, 4)], {1: 1, 2: 2, 3: 3, 4: 3}),
    "across midnight": ([say(1, 200, 1), say(1, 400, 2), say(1, 900, 3)], {1: 1, 2: 1, 3: 1}),
    "command on an earlier day": ([say(1, 0, 1), say(1, 200, 2, command=True), say(1, 400, 3)], {1: 1, 3: 2}),
}


@pytest.mark.parametrize("name", CASES)
def test_goldens(spark, name):
    rows, want = CASES[name]
    got = stitch.stitched(spark.createDataFrame(rows, SCHEMA))
    assert {r.message_id: r.entry_no for r in got.collect()} == want == replay(rows)


def test_random_messages_match_replay(spark):
    r = random.Random(8)
    rows = [say(r.randint(1, 4), r.randint(0, 200) * 300, n, command=r.random() < 0.2, feedback=r.random() < 0.1) for n in range(400)]
    rows = [(*x[:4], x[4] and not x[3], x[5]) for x in rows]
    got = stitch.stitched(spark.createDataFrame(rows, SCHEMA))
    assert {x.message_id: x.entry_no for x in got.collect()} == replay(rows)


def test_texts_join_in_time_order(spark):
    rows = [say(1, 20, 1), say(1, 10, 2)]
    got = stitch.entries(spark.createDataFrame(rows, SCHEMA), body=F.col("message_id").cast("string")).first()
    assert (got.full_text, got.window_end, got.messages) == ("2\n1", at(20), 2)


def test_ready_is_strict(spark):
    df = spark.createDataFrame([(1, "c", at(0), "pending"), (2, "c", at(1), "pending"), (3, "c", at(0), "error")], "user_id int, channel string, window_end timestamp_ntz, status string")
    assert [r.user_id for r in stitch.ready(df, F.lit(at(601))).collect()] == [1]
    assert stitch.ready(df, F.lit(at(600))).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [say(r.randint(1, 3), r.randint(0, 500) * 60, n, command=r.random() < 0.1) for n in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    # three files in time order, read one per batch; a late sentinel closes what is open
    edge = [at(10_000), at(20_000)]
    parts = [df.filter(F.col("ts") < edge[0]), df.filter((F.col("ts") >= edge[0]) & (F.col("ts") < edge[1])), df.filter(F.col("ts") >= edge[1]), spark.createDataFrame([say(9, 10_000_000, 999)], SCHEMA)]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    capture.drain(capture.stitch_stream(stream), str(tmp_path / "cp"), sinks.append_batch(str(tmp_path / "out")))
    got = spark.read.schema(capture.OUT).parquet(str(tmp_path / "out"))
    pick = lambda d: sorted((x.user_id, x.window_start, x.window_end, x.messages) for x in d.collect())
    want = stitch.entries(df)
    assert pick(got) == pick(want)
