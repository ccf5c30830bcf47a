"""Behaviour over time: accepted requests, waiting jobs, progress and expiry, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

DECISION = "key string, event_id long, ts timestamp_ntz, accepted boolean, retry_after long"


def decide(times: list, ts, limit: int, window: float) -> tuple[bool, int, list]:
    """One request at ts against the accepted ones before it: verdict, seconds to wait, accepted times that still count.

    An accepted request exactly `window` seconds old still counts; refused ones are not recorded.
    """
    live = [t for t in times if t >= ts - timedelta(seconds=window)]
    if len(live) < limit:
        return True, 0, [*live, ts]
    wait = int((live[0] + timedelta(seconds=window) - ts).total_seconds()) + 1
    return False, max(1, wait), live


def limiter(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Verdict on each request of each key in order of time. events: key, event_id, ts.

    Whether a request is accepted depends on which earlier ones were, so a frame over all earlier ones would be wrong.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        times, out = [], []
        for r in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
            ok, wait, times = decide(times, r.ts, limit, window)
            out.append((r.key, r.event_id, r.ts, ok, wait))
        return pd.DataFrame(out, columns=["key", "event_id", "ts", "accepted", "retry_after"])

    return events.select(F.col("key").cast("string"), "event_id", "ts").groupBy("key").applyInPandas(fold, DECISION)


def limiter_stream(events: DataFrame, limit: int, window: float, lateness: float | None = None) -> DataFrame:
    """The same on a stream, with the accepted times of a key as its state.

    A key that is silent for a window is forgotten: nothing it did counts any more. Requests that come later than
    `lateness` seconds (a window, unless said) after the newest get no verdict.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = [pd.Timestamp(t).to_pydatetime() for t in state.get[0]] if state.exists else []
        out = []
        if state.hasTimedOut:
            state.remove()
            return
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            ok, wait, times = decide(times, r.ts.to_pydatetime() if hasattr(r.ts, "to_pydatetime") else r.ts, limit, window)
            out.append((r.key, r.event_id, r.ts, ok, wait))
        if times:
            state.update(([t.isoformat() for t in times],))
            last = pd.Timestamp(times[-1] + timedelta(seconds=window))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "accepted", "retry_after"])

    keyed = events.select(F.col("key").cast("string"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", f"{window if lateness is None else lateness} seconds")
    return keyed.groupBy("key").applyInPandasWithState(fold, DECISION, "times array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Jobs ahead of each waiting job in its queue; -1 for running ones. jobs: queue, job_id, stage, enqueued_at."""
    waiting = F.col("stage") == "queued"
    w = Window.partitionBy("queue", waiting).orderBy("enqueued_at", "job_id")
    return jobs.withColumn("position", F.when(waiting, F.row_number().over(w) - 1).otherwise(-1).cast("long"))


def expired(jobs: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Jobs whose last update is older than the time to live. jobs: job_id, updated_at (timestamp_ntz)."""
    age = F.timestamp_diff("SECOND", F.col("updated_at"), F.lit(now).cast("timestamp_ntz"))
    return jobs.withColumn("age_seconds", age).where(F.col("age_seconds") > ttl_seconds)


def orphans(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders without a job and jobs without a folder. Both: job_id."""
    f, j = folders.select("job_id", F.lit(True).alias("has_folder")), jobs.select("job_id", F.lit(True).alias("has_job"))
    joined = f.join(j, "job_id", "full_outer")
    return joined.where("has_folder is null or has_job is null").select("job_id", F.when(F.col("has_folder").isNull(), "job").otherwise("folder").alias("only"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in event-time windows; rows later than the watermark are dropped from a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
