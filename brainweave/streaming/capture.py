"""Streaming forms of the time-driven operators: stitching, and drains that repeat a batch safely.

Stitching keeps, per user and channel, the open entry only. Messages that come later than the watermark are dropped by
Spark, whereas the archive would append them to a closed entry: a documented difference. Everything else gives what the batch
operator gives on the same messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, channel string, window_start timestamp, window_end timestamp, messages long"
STATE = "start long, end long, messages long, alone boolean, command long"
NONE = -(1 << 62)


def stitch_stream(messages: DataFrame, gap_seconds: int = 600, delay: str = "10 minutes") -> DataFrame:
    """messages (user_id, channel, ts, is_command, is_feedback, message_id) as a stream of closed entries.

    An entry is closed by the message that opens the next one, or when the watermark passes its end by the gap.
    """
    gap = gap_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        start, end, n, alone, command = state.get if state.exists else (NONE, NONE, 0, False, NONE)

        def close() -> None:
            if n:
                done.append((*key, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            # plain lists: a key has few rows, and building a frame costs more than they do
            parts = [(b["ts"].to_numpy("datetime64[us]").astype("int64"), b["is_command"].to_numpy(bool), b["is_feedback"].to_numpy(bool), b["message_id"].to_numpy()) for b in batches]
            us, command_, feedback, ids = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((ids, ~command_, us))
            for at, is_command, is_feedback in zip(us[order].tolist(), command_[order].tolist(), feedback[order].tolist()):
                if is_command:
                    command = max(command, at)
                    continue
                if not n or is_feedback or alone or at - end >= gap or command > end:
                    close()
                    start, n = at, 0
                end, n, alone = at, n + 1, is_feedback
            state.update((start, end, n, alone, command))
            state.setTimeoutTimestamp(max(end + gap, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        columns = ["user_id", "channel", "window_start", "window_end", "messages"]
        if done:
            yield pd.DataFrame(done, columns=columns)

    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("user_id", "channel").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(messages: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Messages per event type and window, once the watermark has passed."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Runs a stream over all that has arrived. write(batch, number) may be called again for a number after a failure."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
