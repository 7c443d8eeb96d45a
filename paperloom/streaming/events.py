"""Streaming forms of the stateful event operators.

Login-failure sessions are event-time session windows behind a watermark: a
session is emitted once no later event can join it. Monotonic progress keeps one
small state row per job (last status and highest progress), so state grows with
the number of live jobs and expires by timeout. Late data beyond the watermark is
dropped, which is a choice of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.windows import failure_sessions


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many files per trigger (the queue's concurrency cap)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def failure_session_stream(events: DataFrame, gap: str, limit: int, late: str) -> DataFrame:
    """(user_id, start, n, limited) of error events, append mode."""
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return failure_sessions(errors, "user_id", "ts", gap, limit)


def progress_stream(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """(user_id, event_id, status, top): rows at which status or the highest progress changes.

    Within a trigger rows are taken in event order; progress never falls, as the
    state holds the highest value so far.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, top = state.get if state.exists else (None, -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, event, progress in zip(rows.event_id, rows.event_type, rows.progress, strict=True):
            high = max(top, int(progress))
            if (event, high) != (status, top):
                out.append((key[0], int(event_id), event, high))
            status, top = event, high
        state.update((status, top))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "status", "top"])

    rows = events.select("user_id", "event_id", "ts", "event_type", (F.col("event_id") % 101).alias("progress"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, status string, top long", "status string, top long", "append", GroupStateTimeout.ProcessingTimeTimeout)
