"""As-of look-ups, built on running peaks over points and probes in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.operators.ordered import peak, running

_TS, _PROBE, _ROW = "_ts", "_is_probe", "_row"


def asof_peak(
    points: DataFrame,
    probes: DataFrame,
    point_ts: str,
    probe_ts: str,
    values: dict[str, Column],
    keys: list[str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """For each probe the largest value among points with `point_ts` <= `probe_ts`.

    The peak, not the last value: the two differ once a counter has fallen.
    Points sort before probes of the same instant, which makes the bound inclusive. Points of one instant
    become one first, so however many there are, they fill no block.
    """
    keys = keys or []
    known = points.select(*keys, F.col(point_ts).alias(_TS), *[v.alias(f"_v_{n}") for n, v in values.items()])
    left = known.groupBy(*keys, _TS).agg(*[F.max(f"_v_{n}").alias(f"_v_{n}") for n in values]).withColumn(_PROBE, F.lit(0))
    right = probes.select(
        *keys,
        F.col(probe_ts).alias(_TS),
        F.lit(1).alias(_PROBE),
        F.struct(*probes.columns).alias(_ROW),
    )
    merged = left.unionByName(right, allowMissingColumns=True)
    measured = running(
        merged, keys, [_TS, _PROBE], {n: peak(F.col(f"_v_{n}")) for n in values}, split=split
    )
    return measured.where(F.col(_PROBE) == 1).select(f"{_ROW}.*", *values)


def covered_by(
    samples: DataFrame,
    spans: DataFrame,
    sample_ts: str,
    start: str,
    end: str,
    kinds: dict[str, Column],
    keys: list[str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Flag each sample that lies in some span of a kind, both ends closed.

    A sample is covered exactly when the furthest end among the spans that have
    started reaches it, so no sample-span pair is ever formed.
    """
    reach = {name: F.when(condition, F.col(end)) for name, condition in kinds.items()}
    seen = asof_peak(spans, samples, start, sample_ts, {f"_reach_{n}": v for n, v in reach.items()}, keys, split)
    flags = [F.coalesce(F.col(f"_reach_{n}") >= F.col(sample_ts), F.lit(False)).alias(n) for n in kinds]
    return seen.select(*samples.columns, *flags)


def state_label(
    samples: DataFrame,
    spans: DataFrame,
    sample_ts: str,
    start: str,
    end: str,
    kind: str,
    keys: list[str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Label samples idle, backup or restore; backup wins when both hold."""
    kinds = {"_backup": F.col(kind) == "backup", "_restore": F.col(kind) == "restore"}
    flagged = covered_by(samples, spans, sample_ts, start, end, kinds, keys, split)
    label = F.when(F.col("_backup"), "backup").when(F.col("_restore"), "restore").otherwise("idle")
    return flagged.withColumn("state", label).drop("_backup", "_restore")


def latest_before(
    cycles: DataFrame,
    targets: DataFrame,
    cycle_ts: str,
    cycle_id: str,
    target_ts: str,
    keys: list[str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """The newest cycle at or before each target; of equal stamps the smallest id.

    Targets without an earlier cycle keep NULL.
    """
    keys = keys or []
    firsts = cycles.groupBy(*keys, cycle_ts).agg(F.min(cycle_id).alias(cycle_id))
    newest = F.struct(F.col(cycle_ts).alias("ts"), F.col(cycle_id).alias("id"))
    seen = asof_peak(firsts, targets, cycle_ts, target_ts, {"_newest": newest}, keys, split)
    return seen.withColumn("target_cycle", F.col("_newest.id")).drop("_newest")
