"""Intents that become due in a stream: timers by event time, one a bucket of intents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stream holds: an intent is remembered (with due_at) or cancelled, at a time.
INTENT_EVENTS = "id long, at timestamp, kind string, due_at timestamp"
DUE = "id long, due_ms long, late boolean"
#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Rows that a bucket gets in all, about, where the caller tells how many there are.
BUCKET_ROWS = 4000
#: Buckets where nobody tells; they stay as they are as long as the stream's checkpoint.
BUCKETS = 1024
#: A time that never comes: that of an intent not told yet, or not cancelled.
NEVER = np.iinfo(np.int64).max


def _first(ids: np.ndarray, x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The least x of each id in `of` (sorted, distinct); NEVER without any."""
    out = np.full(len(of), NEVER)
    np.minimum.at(out, np.searchsorted(of, ids), x)
    return out


class DueIntents(StatefulProcessor):
    """Of each intent: when it is due and when it was cancelled. Intents lie in buckets, whose state is rows of id, due and
    cancelled; a bucket's timer stands at the first time among them. Where it fires, the intents due by then are told,
    unless they were cancelled by then. An intent that is overdue when it comes is told at once, as late. What was due
    leaves the state; so does a cancellation without an intent when its own time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("intents", "rows binary")

    def _open(self) -> np.ndarray:
        return np.frombuffer(self.state.get()[0], np.int64).reshape(3, -1) if self.state.exists() else np.zeros((3, 0), np.int64)

    def _keep(self, rows: np.ndarray, now: int) -> None:
        """Rows as state, with a timer at the first time that is still to come."""
        if not rows.shape[1]:
            self.state.clear()
            return
        self.state.update((rows.tobytes(),))
        at = np.where(rows[1] < NEVER, rows[1], rows[2])
        if len(at := at[at > now]):
            self.handle.registerTimer(int(at.min()))

    @staticmethod
    def _told(rows: np.ndarray, late: bool) -> pd.DataFrame:
        rows = rows[:, rows[2] > rows[1]]
        return pd.DataFrame({"id": rows[0], "due_ms": rows[1], "late": np.full(rows.shape[1], late)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self._open()
        frame = pd.concat(list(rows))
        told = frame[(frame["kind"] == "remember") & (frame["due_ms"] < NEVER)]
        gone = frame[frame["kind"] == "cancel"]
        ids = np.unique(np.concatenate([was[0], told["id"].to_numpy(), gone["id"].to_numpy()]))
        old = _first(was[0], was[1], ids)
        due = np.where(old < NEVER, old, _first(told["id"].to_numpy(), told["due_ms"].to_numpy(), ids))  # the first that was told stays
        cancelled = np.minimum(_first(was[0], was[2], ids), _first(gone["id"].to_numpy(), gone["at_ms"].to_numpy(), ids))
        now = timerValues.getCurrentWatermarkInMs()
        open_ = np.stack([ids, due, cancelled])
        late = (due <= now) & (old == NEVER)
        self._keep(open_[:, ~late], now)
        if late.any():
            yield self._told(open_[:, late], True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = self._open()
        at = np.where(rows[1] < NEVER, rows[1], rows[2])
        ends = at <= now
        if ends.any():
            self._keep(rows[:, ~ends], now)
        due = ends & (rows[1] < NEVER)
        if due.any():
            yield self._told(rows[:, due], False)

    def close(self) -> None:
        pass


def buckets_for(n: int) -> int:
    """Buckets for so many events in all."""
    return max(1, -(-n // BUCKET_ROWS))


def due_intents(events: DataFrame, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """id, due_ms, late of the intents that are due by the watermark, each once. A task's call of Python is for a bucket of
    intents and not for each, so give as many `buckets` as keep a bucket's open intents to some thousands. Events without an id belong to no intent."""
    rows = events.where("id is not null").withWatermark("at", delay)
    due_ms = F.coalesce(F.unix_millis("due_at"), F.lit(NEVER))
    rows = rows.select("id", "at", "kind", F.unix_millis("at").alias("at_ms"), due_ms.alias("due_ms"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(DueIntents(), DUE, "update", "eventTime")
