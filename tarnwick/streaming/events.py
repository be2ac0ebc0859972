"""Event-time windows and the token bucket over an event stream; each also works on a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.config import ConfigError

DECISION = "user_id long, event_id long, allowed boolean, tokens double"


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per window and type."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return per.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and session."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return per.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def refill(tokens: float, last: float, now: float, rate: float, capacity: float) -> float:
    """Continuous refill; a clock that runs backwards grants nothing."""
    return min(capacity, tokens + max(0.0, now - last) * rate)


def take(pdf: pd.DataFrame, tokens: float, last: float | None, rate: float, capacity: float) -> tuple[list[tuple], float, float]:
    out = []
    pdf = pdf.sort_values(["ts", "event_id"])
    for user, event, at in zip(pdf["user_id"], pdf["event_id"], pdf["ts"].astype("int64") / (1e9 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1e6)):
        tokens = refill(tokens, at if last is None else last, at, rate, capacity)
        last = at if last is None else max(last, at)
        allowed = tokens >= 1.0
        tokens -= allowed
        out.append((user, event, bool(allowed), round(tokens, 6)))
    return out, tokens, last if last is not None else 0.0


def token_bucket(events: DataFrame, per_minute: float = 60.0, capacity: float | None = None, late: str = "10 minutes") -> DataFrame:
    """A decision for every event.  On a stream, the state of each user survives batches and expires when idle.

    On a table, a user's events are taken in order, in Arrow batches, so a busy user is never held as a whole;
    on a stream, those of one micro-batch are, to be put in order.  A rate of 0 never refills.
    """
    if per_minute < 0 or (capacity is not None and capacity < 0):
        raise ConfigError("rate and capacity must not be negative")
    cap, rate = per_minute if capacity is None else capacity, per_minute / 60.0
    idle = int(1000 * max(60.0, cap / rate * 2)) if rate else 10 * 365 * 86_400_000

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (cap, None)
        rows: list[tuple] = []
        held = pd.concat(list(parts))
        rows, tokens, last = take(held, tokens, last, rate, cap)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed", "tokens"])

    if events.isStreaming:
        watched = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
        return watched.groupBy("user_id").applyInPandasWithState(step, DECISION, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last = None, cap, None
        for p in parts:
            rows: list[tuple] = []
            for u, own in p.groupby("user_id", sort=False):
                if u != user:
                    user, tokens, last = u, cap, None
                done, tokens, last = take(own, tokens, last, rate, cap)
                rows += done
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed", "tokens"])

    ordered = events.select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(fold, DECISION)
