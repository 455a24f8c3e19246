"""Stitching that takes messages in any order: closed entries are reopened, joined or split, and every change is sent on as a new version.

Two clocks are kept apart. A message's own time orders it among the others, however late it comes; the time it arrived is the stream's
event time, so its watermark only decides when an entry counts as closed and never drops a message. After each micro-batch the
latest versions are just the entries that the batch operator makes of all messages so far.

Users are dealt by hash to ``BUCKETS`` of each channel, and a bucket is a key of Spark's: a call to state, a timer and a frame of pandas cost far
more than the few rows of a user in a batch, so a bucket's users share them and are cut together. State of a bucket, in RocksDB: messages (25
bytes each) and the entries that start among them, by user and time in pages of ``PAGE`` to ``2 * PAGE`` rows, and one row with the pages' bounds, in which
a single page is kept itself. A message reads and writes its own page, and the pages next to it as far as the same user's messages follow
each other within the gap; pages are parted where they don't, if they can be. Rows of a micro-batch are taken in portions of ``PORTION``, and
``TOGETHER`` pages at a time. So a user with a third of all messages costs a task as many pages as the batch touches, never its history at once; only
an entry that itself spans many pages is cut again as a whole. Only a bucket's earliest entry to close has a timer. State has no expiry, or
late messages couldn't be placed.

Defined cases: rows without a user, channel or time are left out; a message that is sent twice counts twice, as in the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

CHANGE = "user_id long, channel string, start long, nth int, end long, messages long, closed boolean, retracted boolean, version long"
OUT = "user_id long, channel string, window_start timestamp, nth int, window_end timestamp, messages long, closed boolean, retracted boolean, version long"
KEY = ["user_id", "channel"]
#: Keys that the users of a channel are dealt to. A stream that goes on keeps its number.
BUCKETS = 1024
#: Rows of one key that are put into state at a time, and pages.
PORTION, TOGETHER = 50_000, 64
#: Rows of a page, up to twice as many; more only if they are of one user and instant.
PAGE = 2048
COMMAND, MESSAGE, FEEDBACK = 0, 1, 2
ROW = np.dtype([("us", "<i8"), ("kind", "u1"), ("id", "<i8")])
KEYED = np.dtype([("user", "<i8"), *ROW.descr])
ENTRY = np.dtype([("user", "<i8"), ("start", "<i8"), ("nth", "<i4"), ("end", "<i8"), ("n", "<i8"), ("closed", "?")])
LEAST, FAR = -(1 << 63), 1 << 62
#: A page's number, from which user and time on it is, its first and last message if it has one (said), and when its next entry closes (ms).
BOUNDS = np.dtype([("page", "<i8"), ("user", "<i8"), ("us", "<i8"), ("said", "?"), ("first_user", "<i8"), ("first", "<i8"), ("last_user", "<i8"), ("last", "<i8"), ("due", "<i8")])


def _users(rows: np.ndarray) -> np.ndarray:
    return rows["user"] if "user" in rows.dtype.names else np.zeros(len(rows), np.int64)


def in_order(rows: np.ndarray) -> np.ndarray:
    """By user, if there are several, and time; commands before messages of the same instant, then by id."""
    return rows[np.lexsort((rows["id"], rows["kind"] > 0, rows["us"], _users(rows)))]


def cut(rows: np.ndarray, gap: int) -> np.ndarray:
    """The entries of sorted rows; before a user's first nothing stands within the gap."""
    at = np.flatnonzero(rows["kind"] > 0)
    if not len(at):
        return np.zeros(0, ENTRY)
    command = np.maximum.accumulate(np.where(rows["kind"] == COMMAND, np.arange(len(rows)), -1))[at]
    us, alone, user = rows["us"][at], rows["kind"][at] == FEEDBACK, _users(rows)[at]
    new = np.ones(len(us), bool)
    # a command that stands between two messages is later than the first of them
    new[1:] = alone[1:] | alone[:-1] | (us[1:] - us[:-1] >= gap) | (command[1:] > at[:-1]) | (user[1:] != user[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(us)) - 1
    out = np.zeros(len(first), ENTRY)
    out["user"], out["start"], out["end"], out["n"] = user[first], us[first], us[last], last - first + 1
    moved = np.append(True, (np.diff(out["start"]) != 0) | (np.diff(out["user"]) != 0))
    run = np.maximum.accumulate(np.where(moved, np.arange(len(out)), 0))
    out["nth"] = np.arange(len(out)) - run  # feedback may open several entries in one instant
    return out


def paged(rows: np.ndarray, gap: int) -> list[np.ndarray]:
    """Sorted rows in pages, parted before a user's first row or a message that is not within the gap of the one before, if there is one in reach."""
    if len(rows) <= 2 * PAGE:
        return [rows]
    us, user = rows["us"], rows["user"]
    other = np.append(True, np.diff(user) != 0)
    instant = np.flatnonzero(other | np.append(True, np.diff(us) != 0))  # the first rows of each user's instants
    said = np.flatnonzero(rows["kind"] > 0)
    apart = said[1:][(np.diff(us[said]) >= gap) & (np.diff(user[said]) == 0)]
    free = np.union1d(np.flatnonzero(other), instant[np.searchsorted(instant, apart, "right") - 1])
    cuts = [0]
    while len(rows) - cuts[-1] > 2 * PAGE:
        near = [int(places[i]) for places in (free, instant) if (i := np.searchsorted(places, cuts[-1] + PAGE)) < len(places)]
        near = [n for n in near if n <= cuts[-1] + 2 * PAGE] or near[-1:]
        if not near:
            break
        cuts.append(near[0])
    return [rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)])]


def places(bounds: np.ndarray, user: np.ndarray, us: np.ndarray) -> np.ndarray:
    """The page of each user and time."""
    n = len(bounds)
    order = np.lexsort((np.arange(n + len(us)) >= n, np.append(bounds["us"], us), np.append(bounds["user"], user)))
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(order < n) - 1
    return found[n:]


def regions(bounds: np.ndarray, gap: int) -> np.ndarray:
    """A number for each page, the same for pages that messages tie together; pages of commands lie between without tying."""
    said = np.flatnonzero(bounds["said"])
    a, b = bounds[said[:-1]], bounds[said[1:]]
    tied = (a["last_user"] == b["first_user"]) & (b["first"] - a["last"] < gap)
    ties = np.zeros(len(bounds) + 1, np.int64)
    np.add.at(ties, said[:-1][tied] + 1, 1)
    np.add.at(ties, said[1:][tied] + 1, -1)
    return np.cumsum(np.cumsum(ties)[:-1] == 0)


def widened(bounds: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bounds with the messages among sorted rows, that come to these pages."""
    out, said = bounds.copy(), rows["kind"] > 0
    rows, (k, first) = rows[said], np.unique(at[said], return_index=True)
    lo, hi = rows[first], rows[np.append(first[1:], len(rows)) - 1] if len(rows) else rows
    old = out[k]
    less = ~old["said"] | (lo["user"] < old["first_user"]) | ((lo["user"] == old["first_user"]) & (lo["us"] < old["first"]))
    more = ~old["said"] | (hi["user"] > old["last_user"]) | ((hi["user"] == old["last_user"]) & (hi["us"] > old["last"]))
    out["first_user"][k[less]], out["first"][k[less]] = lo["user"][less], lo["us"][less]
    out["last_user"][k[more]], out["last"][k[more]] = hi["user"][more], hi["us"][more]
    out["said"][k] = True
    return out


def changes(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, retracted): new entries that are not among the old ones as they are, and old ones whose place is gone, in order."""
    both, is_new = np.concatenate([old, new]), np.repeat([False, True], [len(old), len(new)])
    order = np.lexsort((is_new, both["nth"], both["start"], both["user"]))
    both, is_new = both[order], is_new[order]
    met = np.all([both[c][1:] == both[c][:-1] for c in ("user", "start", "nth")], axis=0)
    equal = met & np.all([both[c][1:] == both[c][:-1] for c in ("end", "n", "closed")], axis=0)
    sent = np.where(is_new, ~np.append(False, equal)[: len(both)], ~np.append(met, False)[: len(both)])
    return both[sent], ~is_new[sent]


def due(entries: np.ndarray, gap: int) -> int:
    """When the next of them closes, in ms."""
    ends = entries["end"][~entries["closed"]]
    return -(-(int(ends.min()) + gap) // 1000) if len(ends) else FAR


class History:
    """The pages of a bucket."""

    def __init__(self, head, pages, gap: int) -> None:
        self.head, self.pages, self.gap = head, pages, gap
        empty = np.zeros(1, BOUNDS)
        empty["user"], empty["us"], empty["due"] = LEAST, LEAST, FAR
        self.version, self.due, bounds, rows, entries = head.get() or (0, FAR, empty.tobytes(), b"", b"")
        self.bounds, self.alone = np.frombuffer(bounds, BOUNDS), (rows, entries)
        self.next = int(self.bounds["page"].max()) + 1

    def load(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows and entries of a page."""
        rows, entries = self.alone if len(self.bounds) == 1 else self.pages.getValue((int(self.bounds["page"][i]),))
        return np.frombuffer(rows, KEYED), np.frombuffer(entries, ENTRY)

    def write(self, bounds: np.ndarray, rows: list[np.ndarray], entries: list[np.ndarray], alone: bool) -> None:
        for b, r, e in zip(bounds, rows, entries):
            said = r[r["kind"] > 0]
            b["said"], b["due"] = len(said) > 0, due(e, self.gap)
            if len(said):
                b["first_user"], b["first"], b["last_user"], b["last"] = said["user"][0], said["us"][0], said["user"][-1], said["us"][-1]
            if alone:
                self.alone = (r.tobytes(), e.tobytes())
            else:
                self.alone = (b"", b"")
                self.pages.updateValue((int(b["page"]),), (r.tobytes(), e.tobytes()))

    def replaced(self, bounds: np.ndarray, rows: np.ndarray, entries: np.ndarray, kept: set[int]) -> np.ndarray:
        """The bounds of some pages that get these rows and entries, and of those they are parted into; kept: pages that are as they were."""
        at = places(bounds, rows["user"], rows["us"])
        parts, out = [], []
        for b, part in zip(bounds, np.split(rows, np.searchsorted(at, np.arange(1, len(bounds))))):
            for k, page in enumerate(paged(part, self.gap)):
                new = b.copy()
                if k:
                    new["page"], new["user"], new["us"] = self.next, page["user"][0], page["us"][0]
                    self.next += 1
                parts.append(page)
                out.append(new)
        new = np.array(out, BOUNDS)
        own = np.split(entries, np.searchsorted(places(new, entries["user"], entries["start"]), np.arange(1, len(new))))
        alone = len(new) == len(self.bounds) == 1
        change = [i for i in range(len(new)) if int(new["page"][i]) not in kept]
        some = new[change]
        self.write(some, [parts[i] for i in change], [own[i] for i in change], alone)
        new[change] = some
        return new

    def save(self) -> None:
        self.head.update((self.version, self.due, self.bounds.tobytes(), *self.alone))


class Sessions(StatefulProcessor):
    """The entries of a bucket: of some users of a channel."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "version long, due long, bounds binary, rows binary, entries binary")
        self.pages = handle.getMapState("pages", "page long", "rows binary, entries binary")

    def _frame(self, key, history: History, entries: np.ndarray, retracted: np.ndarray) -> pd.DataFrame:
        version = history.version + 1 + np.arange(len(entries))
        history.version += len(entries)
        return pd.DataFrame({
            "user_id": entries["user"], "channel": key[0], "start": entries["start"], "nth": entries["nth"], "end": entries["end"],
            "messages": np.where(retracted, 0, entries["n"]), "closed": entries["closed"] & ~retracted, "retracted": retracted, "version": version,
        })

    def _take(self, key, history: History, new: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Puts rows into their pages, cuts these again and sends what differs from the entries so far."""
        new = in_order(new)
        at = places(history.bounds, new["user"], new["us"])
        region = regions(widened(history.bounds, at, new), self.gap)
        touched = np.flatnonzero(np.isin(region, region[at]))
        starts = np.flatnonzero(np.diff(region[touched], prepend=-1))  # regions are taken as a whole
        cuts = starts[np.flatnonzero(np.diff(starts // TOGETHER, prepend=-1))]
        bounds, behind = [], 0
        for some in np.split(touched, cuts[1:]):
            loaded = [history.load(k) for k in some]
            mine = slice(np.searchsorted(at, some[0]), np.searchsorted(at, some[-1], "right"))
            rows = in_order(np.concatenate([*(r for r, _ in loaded), new[mine]]))
            entries = cut(rows, self.gap)
            entries["closed"] = entries["end"] + self.gap <= watermark
            old = np.concatenate([e for _, e in loaded])
            sent, retracted = changes(old, entries)
            if len(sent):
                yield self._frame(key, history, sent, retracted)
            moved = {int(k) for k in np.append(at[mine], some[places(history.bounds[some], sent["user"], sent["start"])])}
            kept = {int(history.bounds["page"][k]) for k in some.tolist() if k not in moved}
            # pages between those taken stay as they are
            for k, page in self._spread(history, some, history.replaced(history.bounds[some], rows, entries, kept)):
                bounds += [history.bounds[behind:k], page]
                behind = k + 1
        history.bounds = np.concatenate([*bounds, history.bounds[behind:]])

    def _spread(self, history: History, some: np.ndarray, new: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each page with the bounds of those it has become."""
        first = np.flatnonzero(np.isin(new["page"], history.bounds["page"][some]))
        yield from zip(some.tolist(), np.split(new, first[1:]))

    def _remind(self, history: History) -> None:
        """One timer, of the entry that closes first."""
        ms = int(history.bounds["due"].min())
        if ms != history.due:
            if history.due != FAR:
                self.handle.deleteTimer(history.due)
            if ms != FAR:
                self.handle.registerTimer(ms)
            history.due = ms

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        history = History(self.head, self.pages, self.gap)
        held, n = [], 0
        for frame in rows:
            held.append(np.zeros(len(frame), KEYED))
            for c, of in (("user", "user_id"), ("us", "us"), ("kind", "kind"), ("id", "message_id")):
                held[-1][c] = frame[of].to_numpy()
            n += len(frame)
            if n >= PORTION:
                yield from self._take(key, history, np.concatenate(held), watermark)
                held, n = [], 0
        if n:
            yield from self._take(key, history, np.concatenate(held), watermark)
        self._remind(history)
        history.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = timerValues.getCurrentWatermarkInMs()
        history = History(self.head, self.pages, self.gap)
        bounds = history.bounds.copy()
        for i in np.flatnonzero(bounds["due"] <= ms).tolist():
            rows, entries = history.load(i)
            entries = entries.copy()
            over = ~entries["closed"] & (entries["end"] + self.gap <= ms * 1000)
            entries["closed"] |= over
            yield self._frame(key, history, entries[over], np.zeros(over.sum(), bool))
            history.write(bounds[i : i + 1], [rows], [entries], len(bounds) == 1)
        history.bounds, history.due = bounds, FAR  # Spark takes away the timer that has run
        self._remind(history)
        history.save()

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state on disk while a stream is started and run; afterwards the session has its own provider again."""
    key, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, ours)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stitch_versions(messages: DataFrame, gap_seconds: int = 600, delay: str = "0 seconds") -> DataFrame:
    """messages (user_id, channel, ts, is_command, is_feedback, message_id, arrived) as a stream of versions of entries.

    delay: how far arrival times may be out of order; an entry closes that much later.
    """
    kind = F.when(F.col("is_command"), COMMAND).when(F.col("is_feedback"), FEEDBACK).otherwise(MESSAGE)
    rows = messages.select(
        F.col("user_id").cast("long"), "channel", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("kind"),
        F.coalesce(F.col("message_id").cast("long"), F.lit(LEAST)).alias("message_id"), F.col("arrived").cast("timestamp").alias("arrived"),
    ).na.drop(subset=["user_id", "channel", "us", "arrived"])
    # Spark drops rows that are later than the watermark where a stateful operator sees their event time; this one doesn't, so files that are
    # read in another order than they arrived in lose nothing
    timed = rows.withWatermark("arrived", delay).drop("arrived")
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))
    found = dealt.groupBy("channel", "bucket").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), CHANGE, "append", "eventtime")
    times = {"window_start": F.timestamp_micros("start"), "window_end": F.timestamp_micros("end")}
    return found.withColumns(times).select(*StructType.fromDDL(OUT).names)


def latest(versions: DataFrame) -> DataFrame:
    """The entries as they are: of every entry's versions the last, without those taken back."""
    rest = [c for c in versions.columns if c not in (*KEY, "window_start", "nth", "batch")]
    last = versions.groupBy(*KEY, "window_start", "nth").agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select(*KEY, "window_start", "nth", "last.*").filter("NOT retracted").drop("retracted")
