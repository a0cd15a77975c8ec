"""Request outcomes on a stream: done, error, or timed out. One outcome per request, whatever comes late.

The state of a request is its opening time, its first end and whether the outcome is out. Timers are event-time ones:
the first fires when no end can come any more that is earlier than the limit, and settles the request; the second
drops the state after the retention time. Until then a late `done` or a repeated event finds the request closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cycle_analytics.operators.requests import TIMEOUT_SECONDS

OUTCOME = "request_id string, outcome string, waited_s double"
STATE = "opened bigint, ended bigint, how string, closed boolean, settles bigint"
RETENTION_SECONDS = 24 * 3600
ENDS = ("done", "error")
STORE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_timers(spark: SparkSession) -> None:
    """Timers need the state store that keeps several values per key."""
    spark.conf.set(STORE_PROVIDER, ROCKSDB)


class RequestOutcome(StatefulProcessor):
    """Times are microseconds in the state and milliseconds in timers."""

    def __init__(self, timeout_seconds: int, retention_seconds: int):
        self.limit = timeout_seconds * 1_000_000
        self.retention = retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, ended, how, closed, settles = self.state.get() if self.state.exists() else (None, None, None, False, None)
        if closed:
            return
        for batch in rows:
            first, end, state = batch["first"].min(), *earliest_end(batch)
            opened = int(first) if opened is None else min(opened, int(first))
            if end is not None and (ended is None or (end, state) < (ended, how)):
                ended, how = end, state
        # No end before the limit can be pending once the watermark is past it; an earlier opening moves the limit.
        due = (opened + self.limit) // 1000 if ended is None else min(ended, opened + self.limit) // 1000
        due = max(due, timerValues.getCurrentWatermarkInMs() + 1)
        if due != settles:
            if settles is not None:
                self.handle.deleteTimer(settles)
            self.handle.registerTimer(due)
        self.state.update((opened, ended, how, False, due))
        return
        yield  # no row leaves before the timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        opened, ended, how, closed, settles = self.state.get()
        if closed:
            self.state.clear()
            return
        in_time = ended is not None and ended - opened < self.limit
        outcome, waited = (how, (ended - opened) / 1e6) if in_time else ("timeout", self.limit / 1e6)
        forget = max(settles, timerValues.getCurrentWatermarkInMs()) + self.retention
        self.handle.registerTimer(forget)
        self.state.update((opened, ended, how, True, forget))
        yield pd.DataFrame({"request_id": [key[0]], "outcome": [outcome], "waited_s": [waited]})

    def close(self) -> None:
        """Nothing is held open."""


def earliest_end(batch: pd.DataFrame) -> tuple[int | None, str | None]:
    """Time and kind of the first end among summed rows."""
    ends = batch.dropna(subset=["ended"])
    if ends.empty:
        return None, None
    first = ends.sort_values(["ended", "how"]).iloc[0]
    return int(first["ended"]), str(first["how"])


def outcomes(
    events: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, lateness: str = "10 seconds",
    retention_seconds: int = RETENTION_SECONDS,
) -> DataFrame:
    """One row per request; `events` has request_id, state and at (timestamp).

    An event that the watermark has passed is dropped. Ends at one instant go by name.
    """
    use_state_timers(events.sparkSession)
    timed = events.select("request_id", "state", F.col("at").cast("timestamp").alias("at")).withWatermark("at", lateness)
    is_end = F.col("state").isin(*ENDS)
    facts = timed.select(
        "request_id", "at", F.unix_micros("at").alias("first"), F.when(is_end, F.unix_micros("at")).alias("ended"),
        F.when(is_end, F.col("state")).alias("how"),
    )
    return facts.groupBy("request_id").transformWithStateInPandas(
        RequestOutcome(timeout_seconds, retention_seconds), OUTCOME, "append", "eventTime"
    )
