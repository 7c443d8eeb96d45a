"""Stateful streams in event-time order: rows wait in state until the watermark has passed them.

A row is put into a list of its key and a timer is set for the first of the rows that came
together. When the watermark passes a timer, the rows that it has passed are taken in order and
run through the key's state machine, and a timer is set for the first of those that still wait, so rows that come late, but not beyond the watermark, give what the batch form
gives. A key's waiting rows are those of the allowed lateness; its state is one row and
expires by itself some time after it was last written.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Spark starts processes of its own for state machines, which may not find this package; so the classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A state store that holds lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Base of state machines; ``columns`` are the rows' columns behind the time in microseconds."""

    pending_schema = state_schema = ""
    columns: tuple[str, ...] = ()
    output: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                waiting = list(frame[["at", *self.columns]].itertuples(index=False, name=None))
                self.pending.appendList([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in waiting])
                # The first row's timer is enough: when it fires, the rest is given one.
                self._wake(min(row[0] for row in waiting))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All rows that the watermark has passed are due, not only those of this timer.
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        due, rest = [r for r in rows if r[0] // 1000 < now], [r for r in rows if r[0] // 1000 >= now]
        out: list[tuple] = []
        if due:
            if rest:
                self.pending.put(rest)
                self._wake(rest[0][0])
            else:
                self.pending.clear()
            state = tuple(self.state.get()) if self.state.exists() else None
            for row in due:
                state = self.step(key[0], state, row, out)
            self.state.update(state)
            if (until := self.until(state)) is not None:
                self._wake(until)
        self.idle(key[0], now, out)
        yield self._frame(out)

    def _wake(self, at: int) -> None:
        """A timer that fires once the watermark has passed ``at``, in microseconds."""
        self.handle.registerTimer(int(at // 1000 + 1))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(self.output))

    def step(self, key, state: tuple | None, row: tuple, out: list[tuple]) -> tuple:
        """The state after ``row``; results go to ``out``."""
        raise NotImplementedError

    def until(self, state: tuple) -> int | None:
        """When to look at the state again if no row comes, in microseconds."""
        return None

    def idle(self, key, now: int, out: list[tuple]) -> None:
        """Called at each timer, after the rows that were due."""

    def close(self) -> None:
        pass


class Progress(Ordered):
    """Rows at which the status or the highest progress so far changes; after ``keep_ms`` without an event a key begins anew."""

    pending_schema, state_schema = "at long, event_id long, status string, progress long", "status string, top long, last long"
    columns, output = ("event_id", "status", "progress"), ("user_id", "event_id", "status", "top")

    def __init__(self, keep_ms: int | None = None):
        self.keep = keep_ms

    def step(self, key, state, row, out):
        at, event_id, status, progress = row
        if state is not None and self.keep is not None and at - state[2] > 1000 * self.keep:
            state = None
        before, top, _ = state or (None, None, 0)
        high = progress if top is None else max(top, progress)
        if top is None or high != top or status != before:
            out.append((key, event_id, status, high))
        return status, high, at

    def until(self, state):
        return None if self.keep is None else state[2] + 1000 * self.keep

    def idle(self, key, now, out):
        if self.keep is not None and self.state.exists() and self.state.get()[2] < 1000 * (now - self.keep):
            self.state.clear()


class Sessions(Ordered):
    """Runs of events less than ``gap_ms`` apart; one is given out once the watermark is a gap behind its last event."""

    pending_schema, state_schema = "at long, event_id long", "start long, last long, n long"
    columns, output = ("event_id",), ("user_id", "start", "n", "limited")

    def __init__(self, gap_ms: int, limit: int):
        self.gap, self.limit = 1000 * gap_ms, limit

    def step(self, key, state, row, out):
        at = row[0]
        if state is None or state[2] == 0 or at - state[1] >= self.gap:
            if state is not None and state[2]:
                out.append((key, state[0], state[2], state[2] >= self.limit))
            state = (at, at, 0)
        return state[0], at, state[2] + 1

    def until(self, state):
        return state[1] + self.gap

    def idle(self, key, now, out):
        if self.state.exists():
            start, last, n = self.state.get()
            if n and last + self.gap < 1000 * now:
                out.append((key, start, n, n >= self.limit))
                self.state.clear()


def _stamped(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.withColumn("at", F.unix_micros("ts"))


def progress(events: DataFrame, late: str, keep_ms: int | None = None) -> DataFrame:
    """(user_id, event_id, status, top) of a stream with event_id, user_id, ts, status, progress, in append mode."""
    rows = _stamped(events, late).select("user_id", "ts", "at", "event_id", "status", "progress")
    return rows.groupBy("user_id").transformWithStateInPandas(Progress(keep_ms), "user_id long, event_id long, status string, top long", "Append", "EventTime")


def sessions(events: DataFrame, gap_ms: int, limit: int, late: str) -> DataFrame:
    """(user_id, start, n, limited) of a stream with event_id, user_id, ts, in append mode; start in microseconds."""
    rows = _stamped(events, late).select("user_id", "ts", "at", "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(gap_ms, limit), "user_id long, start long, n long, limited boolean", "Append", "EventTime")


def drained(stream: DataFrame, folder: str, seconds: int | None = None) -> DataFrame:
    """Run a stream over what is there now, into ``folder``, and read the rows that were given out; it may be stopped with an error after ``seconds``.

    The folder has to be shared by all executors: the checkpoint and its state are there, too.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        if seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError("the stream did not end")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stored_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events of a data folder as a stream, whether they are one file or many."""
    path = f"{folder}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern, as a path that is a file itself isn't taken for a source.
    return reader.parquet(f"{folder}/events.parque[t]")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder where all executors can write: below the session's checkpoint folder, or its warehouse where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
