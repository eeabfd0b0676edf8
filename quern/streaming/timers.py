"""State per key that ends by itself: token buckets that are forgotten once full, and leases that expire when their holder is silent.

Both are processors of transformWithState over event time, so their state store must be RocksDB (`with_rocksdb`). Events of a batch
are taken in the order of time and id; what is later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ms(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[ms]").astype("int64")


class _Bucket(StatefulProcessor):
    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        tokens, last = self.state.get() if self.state.exists() else (self.capacity, None)
        allowed = []
        for t in _ms(x["ts"]):
            if last is not None:
                tokens = min(self.capacity, tokens + max(0, t - last) * self.rate / 1000)
            last = int(t) if last is None else max(last, int(t))
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        self.state.update((float(tokens), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a bucket that has filled up again is as good as none
        self.handle.registerTimer(last + int((self.capacity - tokens) / self.rate * 1000) + 1)
        yield pd.DataFrame({"event_id": x["event_id"], "user_id": key[0], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "user_id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def token_bucket(events: DataFrame, rate: float, capacity: float = 1.0, lateness: str = "1 minute") -> DataFrame:
    """B7/M6. Which events (event_id, user_id, ts) of a user a bucket of `capacity` tokens, refilled at `rate` a second, lets pass:
    event_id, user_id, allowed. A user's state goes once the watermark is past the time at which the bucket is full again."""
    e = events.withWatermark("ts", lateness)
    return e.groupBy("user_id").transformWithStateInPandas(_Bucket(rate, capacity), "event_id long, user_id long, allowed boolean", "append", "eventTime")


class _Lease(StatefulProcessor):
    """State: worker, attempt, when its holder was last heard of, and whether the job is done. One timer a job is set: the time
    at which a silent holder loses it, or at which a job that is done is forgotten."""

    def __init__(self, ttl_ms: int, keep_ms: int):
        self.ttl, self.keep = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "worker string, attempt long, last_ms long, done boolean")

    def _set(self, worker: str, attempt: int, last: int, done: bool) -> None:
        self.state.update((worker, attempt, last, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if done or worker:
            self.handle.registerTimer(last + (self.keep if done else self.ttl) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        worker, attempt, last, done = self.state.get() if self.state.exists() else ("", 0, -1, False)
        out = []
        for i, t, w, kind, a in zip(x["event_id"], _ms(x["ts"]), x["worker"], x["kind"], x["attempt"]):
            free = worker == "" or t - last > self.ttl
            if done or t < last:
                action = "late" if t < last else "closed"
            elif kind == "acquire":
                action = ("granted" if attempt == 0 else "reclaimed") if free else "held"
            else:  # a holder that was silent too long has lost the job, whether or not its timer has fired yet
                action = kind if w == worker and a == attempt and not free else "fenced"
            if action in ("granted", "reclaimed"):
                worker, attempt, last = w, attempt + 1, int(t)
            elif action in ("beat", "done"):
                last, done = int(t), action == "done"
            out.append((i, key[0], action, attempt))
        self._set(worker, attempt, last, done)
        yield pd.DataFrame(out, columns=["event_id", "job_id", "action", "attempt"]).astype({"event_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        worker, attempt, last, done = self.state.get()
        if done:
            self.state.clear()
            out = []
        else:
            self._set("", attempt, last, False)
            out = [(None, key[0], "expired", attempt)]
        yield pd.DataFrame(out, columns=["event_id", "job_id", "action", "attempt"]).astype({"event_id": "Int64", "job_id": "int64", "action": "object", "attempt": "int64"})

    def close(self) -> None:
        pass


def leases(events: DataFrame, ttl_seconds: float, keep_seconds: float = 3600.0, lateness: str = "1 minute") -> DataFrame:
    """M5. What becomes of lease events (event_id, job_id, ts, worker, kind: acquire, beat or done, attempt): granted, reclaimed (the holder
    was silent for longer than ttl), held (it was not), beat, done, fenced (not the holder's attempt, or heard of too late),
    late, closed (after done); and expired, a row without event_id, when the watermark passes a silent holder's time before another
    takes the job. attempt is the job's after it."""
    e = events.withWatermark("ts", lateness)
    return e.groupBy("job_id").transformWithStateInPandas(_Lease(int(ttl_seconds * 1000), int(keep_seconds * 1000)), "event_id long, job_id long, action string, attempt long", "append", "eventTime")
