"""Progress events folded into chunk states, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK = {"chunk_start": 1, "chunk_progress": 2, "chunk_complete": 3}


def fold_batch(events: DataFrame) -> DataFrame:
    """The last event of each session and chunk by ``seq``: session, chunk, state (started, success or error), entries_count.

    Unknown events are ignored. Ties: the later kind of event, then ``error``.
    """
    rank = F.lit(0)
    for name, r in RANK.items():
        rank = F.when(F.col("event") == name, r).otherwise(rank)
    last = events.withColumn("_r", rank).filter("_r > 0").groupBy("session", "chunk").agg(F.max(F.struct("seq", "_r", (F.col("status") == "error").alias("bad"), "status", "entries_count")).alias("e"))
    return last.select("session", "chunk", F.when(F.col("e._r") < 3, "started").when(F.col("e.status") == "error", "error").otherwise("success").alias("state"), F.coalesce("e.entries_count", F.lit(0)).alias("entries_count"))


def fold_stream(events: DataFrame, time: str | None = None, late: str = "1 hour", idle: int = 24 * 3600) -> DataFrame:
    """The same over a stream: a row for every change of a chunk's state, whatever the order in which its events arrive.

    With the name of an event ``time``, the state of a chunk is dropped when the watermark (``late`` behind the latest event) is
    ``idle`` seconds past its last event, so that what is held is bounded by what goes on; without, it is kept for ever.
    """
    src = _marked(events, time, late) if time else events

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else (-1, 0, 0, "", 0)
        old, latest = best, 0
        for pdf in batches:
            if time and pdf[time].notna().any():
                latest = max(latest, pdf[time].max().value // 1_000_000)
            for e in pdf.itertuples(index=False):
                r = RANK.get(e.event, 0)
                if r:
                    best = max(best, (int(e.seq), r, int(e.status == "error"), e.status or "", int(e.entries_count or 0) if pd.notna(e.entries_count) else 0))
        state.update(best)
        if time:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle * 1000)
        if best != old:
            now = "started" if best[1] < 3 else "error" if best[3] == "error" else "success"
            yield pd.DataFrame({"session": [key[0]], "chunk": [key[1]], "state": [now], "entries_count": [best[4]], "seq": [best[0]]})

    return src.groupBy("session", "chunk").applyInPandasWithState(
        step, "session string, chunk int, state string, entries_count int, seq long", "seq long, rank int, bad int, status string, entries int", "update", "EventTimeTimeout" if time else "NoTimeout"
    )


def _marked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, which needs a time with zone (the session's, UTC); as it is without."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = None, time: str = "ts") -> DataFrame:
    """Events and the sum of their values per tumbling window and type; ``late`` sets the watermark of a stream."""
    src = _marked(events, time, late)
    g = src.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    src = _marked(events, "ts", late)
    g = src.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")
