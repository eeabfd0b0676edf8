"""Structured Streaming forms of the metering operators. Extensions: the same functions serve batches in tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counters(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """M1, M4. Requests and amount by user and day of event time; state of days past the watermark is dropped."""
    w = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", "1 day"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("amount")).select("user_id", F.col("window.start").alias("day"), "n", "amount")


def rolling_latency(events: DataFrame, span: str = "6 hours", slide: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """M2. Approximate p50, p95 and p99 by type over a sliding window."""
    w = events.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", span, slide))
    return w.agg(F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 1000).alias("p")).select("event_type", F.col("window.start").alias("start"), "p")


def unrepeated(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """M8. Each event id once within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def token_bucket(events: DataFrame, rate: float, capacity: float = 1.0) -> DataFrame:
    """M6, B7. A token bucket a user: event_id, user_id, allowed. State is two numbers a user; events of a batch are taken in
    order of time and id."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        x = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in x["ts"].astype("int64") / 1e9 if str(x["ts"].dtype).endswith("[ns]") else x["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
            tokens = capacity if last is None else min(capacity, tokens + max(0.0, t - last) * rate)
            last = t if last is None else max(last, t)
            allowed.append(tokens >= 1)
            tokens -= 1 if allowed[-1] else 0
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"event_id": x["event_id"], "user_id": key[0], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def leases(events: DataFrame, ttl: float) -> DataFrame:
    """M5. Leases of jobs from events (job_id, ts, event_id, worker, kind: acquire, beat or done, attempt): event_id, job_id, accepted,
    attempt. An acquire is accepted if the job is free or its holder has not been heard of for ttl seconds, and raises the
    attempt; a beat or done counts only from the holder of the current attempt, so a zombie's is a no-op; what is older than
    the last accepted event, or comes after done, is dropped. State is four values a job."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worker, attempt, last, done = state.get if state.exists else ("", 0, -1.0, False)
        x = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t, w, kind, a in zip(x["ts"].astype("datetime64[ns]").astype("int64") / 1e9, x["worker"], x["kind"], x["attempt"]):
            mine = w == worker and a == attempt
            ok = not done and t >= last and ((worker == "" or t - last > ttl) if kind == "acquire" else mine)
            if ok:
                last = float(t)
                worker, attempt = (w, attempt + 1) if kind == "acquire" else (worker, attempt)
                done = done or kind == "done"
            out.append((ok, attempt))
        state.update((str(worker), int(attempt), float(last), bool(done)))
        yield pd.DataFrame({"event_id": x["event_id"], "job_id": key[0], "accepted": [o[0] for o in out], "attempt": [o[1] for o in out]})

    return events.groupBy("job_id").applyInPandasWithState(run, "event_id long, job_id long, accepted boolean, attempt long", "worker string, attempt long, last double, done boolean", "append", GroupStateTimeout.NoTimeout)
