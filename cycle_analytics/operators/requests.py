"""Request states from status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_SECONDS = 300


def unclaimed(requests: DataFrame, done: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a done marker."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def request_states(
    events: DataFrame, request: str, state: str, at: str, seq: str, timeout_seconds: int = TIMEOUT_SECONDS
) -> DataFrame:
    """Latest state, outcome and elapsed seconds per request.

    A request is over at its first done or error; if that is later than the limit, or
    never, the requester has timed out. Only aggregates, so a busy request is no burden.
    """
    terminal = F.col(state).isin("done", "error")
    seen = events.groupBy(request).agg(
        F.min(at).alias("opened_at"),
        F.max_by(state, F.struct(at, seq)).alias("last_state"),
        F.min(F.when(terminal, F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(state).alias("state")))).alias("_end"),
    )
    elapsed = (F.unix_micros(F.col("_end.at").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / 1e6
    in_time = F.coalesce(elapsed < timeout_seconds, F.lit(False))
    return seen.select(
        request, "last_state",
        F.when(in_time, F.col("_end.state")).otherwise("timeout").alias("outcome"),
        F.when(in_time, elapsed).otherwise(float(timeout_seconds)).alias("waited_s"),
    )
