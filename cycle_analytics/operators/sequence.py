"""Operators on the order inside a chain, host or user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.functions.derive import busy_percent, pair_mean
from cycle_analytics.operators.asof import asof_peak
from cycle_analytics.operators.ordered import number, previous, running, total
from cycle_analytics.session import is_small, written

# Files of cycles that any task can hold.
FEW_BYTES = 1024 * 1024


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "n", split: bool | None = None) -> DataFrame:
    """1-based sequence number inside each group."""
    return running(df, keys, order, {out: number()}, split=split)


def first_flag(df: DataFrame, keys: list[str], order: list[str], out: str = "is_first", split: bool | None = None) -> DataFrame:
    """Mark the first row of each group."""
    return numbered(df, keys, order, "_n", split).withColumn(out, F.col("_n") == 1).drop("_n")


def nth_rows(
    df: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], n: str, split: bool | None = None
) -> DataFrame:
    """For each row of `wanted` the n-th row of its group; dropped when the group is shorter."""
    return numbered(df, keys, order, n, split).join(wanted, [*keys, n])


def oldest_n(
    cycles: DataFrame, requests: DataFrame, chain: str, cycle_id: str, n: str, split: bool | None = None
) -> DataFrame:
    """The first `n` cycles of each requested chain in id order, with their replay order.

    Adds `available` and `selected`. A request becomes one row per position it takes, so the
    join is on (chain, position) and forms no pair beyond the result.
    """
    counts = cycles.groupBy(chain).agg(F.count(F.lit(1)).alias("available"))
    sized = requests.join(counts, chain).withColumn("selected", F.least(F.col(n).cast("bigint"), F.col("available")))
    return _positions(sized, cycles, chain, cycle_id, "selected", split)


def replay_prefix(
    cycles: DataFrame, targets: DataFrame, chain: str, cycle_id: str, target: str, split: bool | None = None
) -> DataFrame:
    """All cycles of a chain up to and including its target id, in replay order."""
    places = numbered(cycles.select(chain, cycle_id), [chain], [cycle_id], "_place", split)
    reach = asof_peak(places, targets, cycle_id, target, {"_last": F.col("_place")}, [chain], split)
    return _positions(reach.where("_last is not null"), cycles, chain, cycle_id, "_last", split).drop("_last")


def _positions(
    wanted: DataFrame, cycles: DataFrame, chain: str, cycle_id: str, upto: str, split: bool | None
) -> DataFrame:
    """Positions 1..`upto` of each wanted row, met with the numbered cycles.

    On large inputs wanted rows are computed once, though read twice, and of a chain only the cycles up to the furthest
    position that is asked for are kept. Where these are few, as for a few chains, the positions are not dealt by them.
    """
    wanted = wanted.where(F.col(upto) >= 1)
    large = not is_small(wanted)
    if large:
        wanted = written(wanted, "wanted")
    places = wanted.withColumn("replay_order", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(upto))))
    if not large:
        asked = cycles.join(wanted.select(chain).distinct(), chain, "left_semi")
        return numbered(asked, [chain], [cycle_id], "replay_order", split).join(places, [chain, "replay_order"])
    asked = cycles.join(wanted.groupBy(chain).agg(F.max(upto).alias("_furthest")), chain)
    placed = numbered(asked, [chain], [cycle_id], "replay_order", split)
    reached = written(placed.where("replay_order <= _furthest").drop("_furthest"), "reached")
    # Spark takes exploded rows for as few as they were before, and would broadcast them.
    met = F.broadcast(reached) if is_small(reached, FEW_BYTES) else reached.hint("merge")
    return met.join(places, [chain, "replay_order"])


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, split: bool | None = None) -> DataFrame:
    """Running sum inside each group."""
    return running(df, keys, order, {out: total(value)}, split=split)


def change_flag(
    df: DataFrame, order: list[str], column: str, out: str = "changed", keys: list[str] | None = None, split: bool | None = None
) -> DataFrame:
    """Mark rows whose value differs from the row before; the first row is not a change."""
    seen = running(df, keys or [], order, {"_before": previous(F.col(column))}, split=split)
    return seen.withColumn(out, F.coalesce(F.col(column) != F.col("_before"), F.lit(False))).drop("_before")


def rolling_pair_mean(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, split: bool | None = None) -> DataFrame:
    """Mean over this row and the one before it."""
    seen = running(df, keys, order, {"_before": previous(F.col(value))}, split=split)
    return seen.withColumn(out, pair_mean(F.col(value), F.col("_before"))).drop("_before")


def counter_rate(
    df: DataFrame, keys: list[str], order: list[str], idle: str, counted: str, out: str = "busy_percent", split: bool | None = None
) -> DataFrame:
    """Busy percentage between polls of cumulative counters; the first poll has none."""
    seen = running(
        df, keys, order, {"_idle": previous(F.col(idle)), "_total": previous(F.col(counted))}, split=split
    )
    rate = F.when(
        F.col("_total").isNotNull(),
        busy_percent(F.col(idle) - F.col("_idle"), F.col(counted) - F.col("_total")),
    )
    return seen.withColumn(out, rate).drop("_idle", "_total")


def prefix_ok(df: DataFrame, keys: list[str], order: list[str], ok: str, out: str = "prefix_ok", split: bool | None = None) -> DataFrame:
    """Whether this and every earlier row of the group is ok."""
    failures = total(F.when(F.col(ok), 0).otherwise(1))
    return running(df, keys, order, {"_failed": failures}, split=split).withColumn(out, F.col("_failed") == 0).drop("_failed")
