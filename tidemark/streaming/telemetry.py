"""Streams: sessions by pauses, progress of jobs with remaining time, and windowed counts, on Structured Streaming.

Sessions and progress keep a small state for each key in the state store; the windows are Spark's own with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def as_events(stream: DataFrame) -> DataFrame:
    """(key, id, kind, ts, cents): user events with a time that watermarks accept."""
    return stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums of each kind in tumbling or sliding windows; rows later than the watermark are dropped by Spark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select("window.start", "window.end", "kind", "n", "cents")


SESSION = "key long, s timestamp, e timestamp, n long"
SESSION_STATE = "s long, e long, n long"


def pause_sessions(events: DataFrame, pause_seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, s, e, n): sessions that a pause of at least `pause_seconds` (the bound included) closes, sent once closed.

    A session stays open in state until a later row of its key or the watermark shows the pause. Rows that arrive out of
    order within a batch are sorted; one that comes before its key's open session widens it if near enough, else is a
    session by itself."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        pause = int(pause_seconds * 1_000_000)
        now = state.get if state.exists else None
        if state.hasTimedOut:
            done.append(now)
            state.remove()
        else:
            times = sorted(t.value // 1000 for pdf in batches for t in pdf["ts"])  # microseconds
            for t in times:
                if now is None:
                    now = (t, t, 1)
                elif t - now[1] >= pause:
                    done.append(now)
                    now = (t, t, 1)
                elif now[0] - t >= pause:
                    done.append((t, t, 1))
                else:
                    now = (min(now[0], t), max(now[1], t), now[2] + 1)
            state.update(now)
            at = (now[1] + pause) // 1000
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "s": pd.to_datetime([d[0] for d in done], unit="us"), "e": pd.to_datetime([d[1] for d in done], unit="us"), "n": [int(d[2]) for d in done]})

    marked = events.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(step, SESSION, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Fixed value: how a job tells its progress. Numbers may have an exponent, as from a million on.
PROGRESS = r"^@progression ([\d.e+-]+) ([\d.e+-]+) (.+)$"
STATUS = "key long, label string, done double, total double, overall double, left double"
STATUS_STATE = "label string, done double, total double, overall double, began double, at double, finished long"


def progress_lines(lines: DataFrame) -> DataFrame:
    """(key, ts, done, total, label) of lines '@progression <done> <total> <label>'; others are left out."""
    found = lines.select("key", "ts", F.regexp_extract("line", PROGRESS, 1).alias("d"), F.regexp_extract("line", PROGRESS, 2).alias("t"), F.regexp_extract("line", PROGRESS, 3).alias("label"))
    return found.where("d <> ''").select("key", "ts", F.col("d").try_cast("double").alias("done"), F.col("t").try_cast("double").alias("total"), "label").where("done is not null and total > 0")


def job_status(progress: DataFrame, steps: int) -> DataFrame:
    """(key, label, done, total, overall, left): the state of each job after each batch. Overall progress never goes back; a
    new label closes the step before it; the remaining time is told from the third step on or past a quarter of one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, done, total, overall, began, at, finished = state.get if state.exists else (None, 0.0, 1.0, 0.0, None, None, 0)
        for pdf in batches:
            for ts, d, t, name in pdf.sort_values("ts")[["ts", "done", "total", "label"]].itertuples(index=False):
                if label is not None and name != label:
                    finished += 1
                label, done, total, at = name, float(d), float(t), ts.timestamp()
                began = at if began is None else began
                overall = max(overall, min(1.0, (finished + min(1.0, done / total)) / steps))
        state.update((label, done, total, overall, began, at, finished))
        known = overall > 0 and (finished >= 2 or done / total >= 0.25)
        left = (at - began) * (1 - overall) / overall if known and at is not None else None
        yield pd.DataFrame({"key": [key[0]], "label": [label], "done": [done], "total": [total], "overall": [overall], "left": [left]})

    return progress.groupBy("key").applyInPandasWithState(step, STATUS, STATUS_STATE, "update", GroupStateTimeout.NoTimeout)


def peaks(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(op, peak): the largest sample of each operation so far."""
    return samples.withWatermark("ts", late).groupBy("op").agg(F.max("bytes").alias("peak"))


def alarms(samples: DataFrame, least_free: int) -> DataFrame:
    """Samples with too little free memory."""
    return samples.where(F.col("free") < least_free)
