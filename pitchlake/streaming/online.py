"""Streaming forms of the per-sample operators; they share their rules with the batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(samples: DataFrame, ts: str = "ts", late: str = "10 seconds", length: str = "10 seconds") -> DataFrame:
    """Samples per match and fixed window, closed by the watermark."""
    w = samples.withWatermark(ts, late).groupBy("match_id", F.window(ts, length))
    return w.agg(F.count("*").alias("n"), F.avg(F.col("visible").cast("double")).alias("coverage")).select("match_id", "window.start", "window.end", "n", "coverage")


def sessions(samples: DataFrame, ts: str = "ts", late: str = "10 seconds", gap: str = "2 seconds") -> DataFrame:
    """Runs of unseen samples no farther apart than gap: dead time as it goes on."""
    s = samples.where("not visible").withWatermark(ts, late).groupBy("match_id", F.session_window(ts, gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select("match_id", "w.start", "w.end", "n")


def once(candidates: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark."""
    return candidates.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])


#: Times of a match count from its start; the watermark begins at 1970 and would take a sample at 0 for late.
_SHIFT_MS = 86_400_000


def greedy_dedup(events: DataFrame, gap_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """match_id, ts_ms, frame of rows at least gap_ms after the last one taken; rows of a match come in order.

    A match's state is one time. It goes once the watermark (on ts_ms)
    is past the gap: whatever comes then is far enough from the last row taken, so the
    results are the same and a match that is over leaves nothing behind.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        got = []
        for ts, frame in sorted(row for b in batches for row in zip(b["ts_ms"].tolist(), b["frame"].tolist(), strict=True)):
            if last is None or ts - last >= gap_ms:
                got.append((key[0], ts, frame))
                last = ts
        state.update((last,))
        state.setTimeoutTimestamp(max(last + _SHIFT_MS + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(got, columns=["match_id", "ts_ms", "frame"])

    timed = events.withColumn("_ts", F.timestamp_millis(F.col("ts_ms") + _SHIFT_MS)).withWatermark("_ts", late)
    return timed.groupBy("match_id").applyInPandasWithState(step, "match_id long, ts_ms long, frame long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
