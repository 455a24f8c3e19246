import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from brainweave.operators import stitch
from brainweave.sources import sinks
from brainweave.streaming import capture, late
from pyspark.sql import functions as F

SCHEMA = "user_id long, channel string, ts timestamp_ntz, is_command boolean, is_feedback boolean, message_id long, arrived timestamp"
T = dt.datetime(2024, 1, 1, 22, 0)


def message(r, n, seconds):
    command = r.random() < 0.1
    return (r.randint(1, 3), "c", T + dt.timedelta(seconds=seconds), command, not command and r.random() < 0.08, n)


@pytest.fixture
def rocks(spark):
    with late.rocksdb(spark):
        yield


def streamed(spark, tmp_path, batches, gap=600, schema=SCHEMA):
    """The versions after each of some batches of rows; a batch arrives an hour after the one before."""
    for i, rows in enumerate(batches):
        arrived = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=i)
        spark.createDataFrame([(*x, arrived) for x in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    capture.drain(late.stitch_versions(stream, gap), str(tmp_path / "cp"), sinks.append_batch(str(tmp_path / "out")))
    return spark.read.schema(late.OUT + ", batch long").parquet(str(tmp_path / "out"))


def pick(df):
    return sorted((x.user_id, x.channel, x.window_start, x.window_end, x.messages) for x in df.collect())


@pytest.mark.parametrize("seed, portion", [(1, 50_000), (2, 7)])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, rocks, monkeypatch, seed, portion):
    monkeypatch.setattr(late, "PORTION", portion)
    r = random.Random(seed)
    rows = [message(r, n, r.choice([r.randint(0, 40), r.randint(0, 900)]) * 200) for n in range(260)]
    r.shuffle(rows)
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    versions = streamed(spark, tmp_path, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])])
    every = spark.createDataFrame([(*x, None) for x in rows], SCHEMA)
    assert pick(late.latest(versions)) == pick(stitch.entries(every))
    assert versions.filter("retracted").count() > 0  # entries were joined or split on the way
    assert all(x.closed for x in late.latest(versions).collect())


def one(seconds, n, command=False, feedback=False):
    return (1, "c", T + dt.timedelta(seconds=seconds), command, feedback, n)


def test_reopened_joined_and_split(spark, tmp_path, rocks):
    batches = [[one(0, 1), one(900, 2)], [one(450, 3)], [one(1000, 4)], [one(500, 5, command=True)], [one(-86_400 * 3, 6)]]
    versions = streamed(spark, tmp_path, batches)
    at = lambda s: T + dt.timedelta(seconds=s)
    steps = [[(x.window_start, x.window_end, x.messages, x.retracted) for x in versions.filter(F.col("batch") == i).orderBy("version").collect()] for i in range(5)]
    flat = [s for step in steps for s in step]
    assert (at(0), at(900), 3, False) in flat  # the late message joined two entries
    assert (at(900), at(900), 0, True) in flat  # and the second was taken back
    assert (at(0), at(1000), 4, False) in flat  # a closed entry went on
    assert pick(late.latest(versions)) == [(1, "c", at(-86_400 * 3), at(-86_400 * 3), 1), (1, "c", at(0), at(450), 2), (1, "c", at(900), at(1000), 2)]


def test_open_until_the_watermark_passes_its_end(spark, tmp_path, rocks):
    now = dt.datetime(2024, 2, 1, 0, 55)  # arrives at 00:00; the next batch at 01:00 is within the gap
    versions = streamed(spark, tmp_path, [[(1, "c", now, False, False, 1)], [(2, "c", T, False, False, 2)], [(2, "c", T, False, False, 3)], [(2, "c", T, False, False, 4)]])
    mine = [(x.closed, x.messages) for x in versions.filter("user_id = 1").orderBy("version").collect()]
    assert mine == [(False, 1), (True, 1)]


def test_batches_that_arrive_out_of_order_lose_nothing(spark, tmp_path, rocks):
    """The first micro-batch is the one that arrived last, so the watermark is hours past the others."""
    for i, hour in enumerate([5, 0, 3, 1]):
        rows = [(*one(i * 60 + 7 * n, 10 * i + n), dt.datetime(2024, 2, 1, hour, tzinfo=dt.timezone.utc)) for n in range(5)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    capture.drain(late.stitch_versions(stream, 600), str(tmp_path / "cp"), sinks.append_batch(str(tmp_path / "out")))
    versions = spark.read.schema(late.OUT + ", batch long").parquet(str(tmp_path / "out"))
    assert [(x.messages, x.window_end, x.closed) for x in late.latest(versions).collect()] == [(20, T + dt.timedelta(seconds=208), True)]


def test_cut_keeps_entries_of_one_instant_apart():
    rows = np.array([(5, late.FEEDBACK, 1), (5, late.MESSAGE, 3), (5, late.FEEDBACK, 2), (6, late.MESSAGE, 4)], late.ROW)
    got = late.cut(late.in_order(rows), 10)
    assert got[["start", "nth", "end", "n"]].tolist() == [(5, 0, 5, 1), (5, 1, 5, 1), (5, 2, 6, 2)]
    assert len(late.cut(np.zeros(0, late.ROW), 10)) == 0


class Kept:
    """State of one key, and its timers; calls are counted."""

    def __init__(self):
        self.value, self.pages, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def called(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def getValue(self, key):
        return self.called(self.pages[key])

    def updateValue(self, key, value):
        self.pages[key] = self.called(value)

    def registerTimer(self, ms):
        self.timers.add(self.called(ms))

    def deleteTimer(self, ms):
        self.timers.remove(self.called(ms))


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def put(kept, sessions, rows, ms, shown):
    """A micro-batch of one key: its rows, then its timers; shown is brought up to date as ``latest`` would."""
    clock = Clock(ms)
    frames = [pd.DataFrame(rows[i : i + 9], columns=["user_id", "us", "kind", "message_id"]) for i in range(0, len(rows), 9)]
    found = list(sessions.handleInputRows(("c", 0), iter(frames), clock)) if rows else []
    for timer in sorted(t for t in kept.timers if t <= ms):
        found += sessions.handleExpiredTimer(("c", 0), clock, None)
        kept.timers.discard(timer)
    for frame in found:
        for r in frame.itertuples():
            assert r.version > shown.get("version", 0)
            shown["version"] = r.version
            place = (r.user_id, r.start, r.nth)
            if r.retracted:
                del shown[place]
            else:
                assert shown.get(place) != (r.end, r.messages, r.closed)  # only changes are sent
                shown[place] = (r.end, r.messages, r.closed)


@pytest.mark.parametrize("seed, page, together, portion", [(1, 4, 2, 11), (2, 3, 64, 1000), (3, 8, 1, 5), (4, 2048, 64, 50_000)])
def test_users_of_a_bucket_are_cut_together_in_pages(monkeypatch, seed, page, together, portion):
    for name, value in (("PAGE", page), ("TOGETHER", together), ("PORTION", portion)):
        monkeypatch.setattr(late, name, value)
    r = random.Random(seed)
    gap, kept, shown, every = 10, Kept(), {}, []
    sessions = late.Sessions(gap)
    sessions.init(kept)
    for ms in [0, 0, 0, 1, 1, 2, 0, 3, 9]:
        span = r.choice([30, 400, 4000])
        rows = [(r.choice([-5, 1, 2, 2]), r.randint(-300, span), r.choices([0, 1, 2], [2, 7, 1])[0], len(every) + i) for i in range(r.choice([0, 1, 40]))]
        every += rows
        r.shuffle(rows)
        put(kept, sessions, rows, ms, shown)
        want = late.cut(late.in_order(np.array([x for x in every], late.KEYED)), gap)
        assert {k: v[:2] for k, v in shown.items() if k != "version"} == {(e["user"], e["start"], e["nth"]): (e["end"], e["n"]) for e in want}
        open_ends = [k for k, v in shown.items() if k != "version" and not v[2]]
        assert all(shown[k][0] + gap > ms * 1000 for k in open_ends) and len(kept.timers) == bool(open_ends)
        bounds = late.History(kept, kept, gap).bounds
        assert (len(bounds) > 1) == (page < 100) or len(every) <= 2 * page


def test_pages_are_of_a_size_and_keep_instants_whole(monkeypatch):
    monkeypatch.setattr(late, "PAGE", 4)
    rows = late.in_order(np.array([(u, 100 * t, k, t) for u in (1, 2) for t in range(9) for k in (0, 1)] + [(3, 7, 1, i) for i in range(20)], late.KEYED))
    pages = late.paged(rows, 50)
    assert (np.concatenate(pages) == rows).all() and [len(p) for p in pages][-1] == 20
    assert all(len(p) <= 8 for p in pages[:-1])
    assert all((a["user"][-1], a["us"][-1]) < (b["user"][0], b["us"][0]) for a, b in zip(pages, pages[1:]))


def test_calls_to_state_grow_with_pages_not_with_users_or_days():
    kept = Kept()
    sessions = late.Sessions(600_000_000)
    sessions.init(kept)
    day = 86_400_000_000
    for late_by in (0, day // 2):
        rows = [(u, d * day + late_by, late.MESSAGE, d) for u in range(20) for d in range(30)]
        put(kept, sessions, rows, 0, {})
    assert kept.calls <= 8
