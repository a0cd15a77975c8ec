"""Statistics of the samples inside spans, without a range join.

Times are whole microseconds and a span is a half-open range [lo, hi) of them. The
range is cut into pieces on a bucket grid:

* whole buckets meet samples that are already aggregated per bucket, with coarser
  grids for the middle of long spans;
* the two ragged ends meet the samples of their one bucket, by equi-join on the bucket
  and an exact test of the bounds.

On large inputs the grid follows the density of the samples, and a bucket that still has
far more than the usual number gets a finer grid of its own, down to one microsecond,
where only aggregated samples are left. So no bucket forms all pairs of its spans and
samples, however many fall into it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cycle_analytics.operators.ordered import same_keys
from cycle_analytics.session import is_small, written

# Each grid is four times as coarse as the one below it.
SHIFT = 2
LEVELS = 2
SAMPLES_PER_BUCKET = 32
BUCKET_ROWS = 256
# A crowded bucket is cut into this many finer ones.
REFINE_SHIFT = 6


def micros(stamp: Column) -> Column:
    """Microseconds since the epoch of a zone-free stamp."""
    return F.unix_micros(stamp.cast("timestamp"))


def span_stats(
    spans: DataFrame,
    samples: DataFrame,
    span_id: str,
    start: Column,
    end: Column,
    sample_ts: str,
    value: str,
    keys: list[str] | None = None,
    closed: bool = True,
    width_seconds: float = 3600.0,
    bucket_rows: int = BUCKET_ROWS,
    split: bool | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Add `n_samples`, `max_value` and `avg_value` of the samples in each span.

    Bounds are both closed or both open. Spans without samples stay, with 0 and NULL. `bounds` has the spans' ids and
    times where they are had without what `spans` carries besides.
    """
    keys = keys or []
    lo, hi = micros(start), micros(end)
    ranges = (spans if bounds is None else bounds).select(
        F.col(span_id).alias("_span"),
        *keys,
        (lo if closed else lo + 1).alias("_lo"),
        (hi + 1 if closed else hi).alias("_hi"),
    ).where(F.col("_lo") < F.col("_hi"))
    points = samples.select(*keys, micros(F.col(sample_ts)).alias("_t"), F.col(value).alias("_v")).where(
        F.col("_v").isNotNull() & F.col("_t").isNotNull()
    )
    if split is None:
        split = not is_small(points)
    width, levels = max(1, int(width_seconds * 1_000_000)), LEVELS
    if split:
        # Written, because the grids read both several times.
        points = written(points, "samples")
        seen = _extent(points, keys)
        ranges = written(_within(ranges, seen), "span-ranges")
        width, levels = _fitting_grid(ranges, seen, width)
    parts = reduce(DataFrame.unionByName, _partials(ranges, points, keys, width, levels, bucket_rows, split))
    stats = parts.groupBy("_span").agg(
        F.sum("_n").alias("n_samples"),
        F.max("_max").alias("max_value"),
        (F.sum("_sum") / F.sum("_n")).alias("avg_value"),
    )
    return (
        spans.join(stats, spans[span_id] == stats["_span"], "left")
        .drop("_span")
        .withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    )


def window_peak_after(
    probes: DataFrame,
    samples: DataFrame,
    probe_id: str,
    probe_ts: str,
    sample_ts: str,
    value: str,
    seconds: float,
    keys: list[str] | None = None,
    empty_as_zero: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Largest sample strictly between a probe and `seconds` later.

    Without a sample the peak is 0, or the probe is dropped.
    """
    end = F.col(probe_ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))
    stats = span_stats(
        probes, samples, probe_id, F.col(probe_ts), end, sample_ts, value, keys,
        closed=False, width_seconds=seconds, split=split,
    )
    if empty_as_zero:
        stats = stats.withColumn("max_value", F.coalesce("max_value", F.lit(0)))
    else:
        stats = stats.where(F.col("n_samples") > 0)
    return stats


def _extent(points: DataFrame, keys: list[str]) -> Row:
    """Number of the samples, their first and last time, and about how many groups they have."""
    groups = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(1)
    return points.agg(F.count("_t").alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi"), groups.alias("groups")).first()


def _within(ranges: DataFrame, seen: Row) -> DataFrame:
    """Ranges as far as there are samples at all: what lies before or after them is not cut into pieces."""
    if not seen["n"]:
        return ranges.limit(0)
    clipped = {"_lo": F.greatest("_lo", F.lit(seen["lo"])), "_hi": F.least("_hi", F.lit(seen["hi"] + 1))}
    return ranges.withColumns(clipped).where(F.col("_lo") < F.col("_hi"))


def _fitting_grid(ranges: DataFrame, seen: Row, widest: int) -> tuple[int, int]:
    """Bucket width for a few samples per bucket, and levels up to the longest span."""
    longest = ranges.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    width = widest
    if seen["n"]:
        per_group = max(1, seen["n"] // max(1, seen["groups"]))
        width = min(widest, max(1, (seen["hi"] - seen["lo"] + 1) * SAMPLES_PER_BUCKET // per_group))
    levels = 1 + max(1, math.ceil(math.log2(max(1, longest / width)) / SHIFT))
    return width, min(levels, 20)


def _run(first: Column, last: Column) -> Column:
    """Bucket numbers first..last, empty when last < first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _down(number: Column) -> Column:
    return F.shiftright(number, SHIFT)


def _up(number: Column) -> Column:
    return -F.shiftright(-number, SHIFT)


def _pieces(ranges: DataFrame, keys: list[str], width: int, levels: int) -> DataFrame:
    """Cut ranges into whole buckets (level >= 1) and ragged ends (level 0)."""
    lo, hi = F.col("_lo"), F.col("_hi")
    cuts = ranges.withColumns(
        {"_i1": F.ceil(lo / F.lit(width)).cast("long"), "_j1": F.floor(hi / F.lit(width)).cast("long")}
    )
    for level in range(2, levels + 1):
        cuts = cuts.withColumns({f"_i{level}": _up(F.col(f"_i{level - 1}")), f"_j{level}": _down(F.col(f"_j{level - 1}"))})

    def node(level: int, bucket: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), bucket.alias("bucket"), start.alias("lo"), end.alias("hi"))

    unbounded = F.lit(None).cast("long")

    def whole_nodes(level: int, numbers: Column) -> Column:
        return F.transform(numbers, lambda bucket: node(level, bucket, unbounded, unbounded))

    i1, j1 = F.col("_i1"), F.col("_j1")
    ends = F.array(
        F.when(i1 > j1, node(0, j1, lo, hi)),
        F.when((i1 <= j1) & (lo < i1 * width), node(0, i1 - 1, lo, i1 * width)),
        F.when((i1 <= j1) & (hi > j1 * width), node(0, j1, j1 * width, hi)),
    )
    parts = [F.filter(ends, lambda x: x.isNotNull())]
    for level in range(1, levels + 1):
        i, j = F.col(f"_i{level}"), F.col(f"_j{level}")
        numbers = _run(i, j - 1)
        if level < levels:
            up_i, up_j = F.col(f"_i{level + 1}"), F.col(f"_j{level + 1}")
            flanks = F.concat(_run(i, F.shiftleft(up_i, SHIFT) - 1), _run(F.shiftleft(up_j, SHIFT), j - 1))
            numbers = F.when(up_i < up_j, flanks).otherwise(numbers)
        parts.append(whole_nodes(level, numbers))
    return cuts.select("_span", *keys, F.inline(F.concat(*parts)).alias("_level", "_bucket", "_lo", "_hi"))


def _grids(placed: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Samples aggregated per bucket on every grid; the coarser grids sum up the finest."""
    sums = [F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.max("_max").alias("_max")]
    finest = placed.groupBy(*keys, "_bucket").agg(
        F.count("_v").alias("_n"), F.sum("_v").alias("_sum"), F.max("_v").alias("_max")
    ).withColumn("_level", F.lit(1))
    if levels == 1:
        return finest
    coarser = finest.drop("_level").withColumn("_level", F.explode(F.sequence(F.lit(2), F.lit(levels))))
    bucket = F.expr(f"shiftright(_bucket, {SHIFT} * (_level - 1))")
    return finest.unionByName(coarser.withColumn("_bucket", bucket).groupBy(*keys, "_bucket", "_level").agg(*sums))


def _partials(
    ranges: DataFrame, points: DataFrame, keys: list[str], width: int, levels: int, bucket_rows: int, split: bool
) -> list[DataFrame]:
    """Partial (_span, _n, _sum, _max) rows whose total per span is the answer."""
    pieces = _pieces(ranges, keys, width, levels)
    placed = points.withColumn("_bucket", F.floor(F.col("_t") / F.lit(width)).cast("long"))
    grids = _grids(placed, keys, levels)
    by = [*keys, "_bucket"]
    finer: list[DataFrame] = []
    if split and width > 1:
        counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        crowded = written(counts.where(F.col("_n") > bucket_rows).drop("_n"), "crowded-buckets")
        if not crowded.isEmpty():
            ends, rest = pieces.where("_level = 0"), pieces.where("_level > 0")
            inner_ends = ends.join(crowded, same_keys(ends, crowded, by), "left_semi").select("_span", *keys, "_lo", "_hi")
            inner_points = placed.join(crowded, same_keys(placed, crowded, by), "left_semi").drop("_bucket")
            # Written, because the finer grid reads both several times.
            finer = _partials(
                written(inner_ends, "span-ends"), written(inner_points, "crowded-samples"), keys,
                max(1, width >> REFINE_SHIFT), REFINE_SHIFT // SHIFT + 1, bucket_rows, split,
            )
            pieces = ends.join(crowded, same_keys(ends, crowded, by), "left_anti").unionByName(rest)
            placed = placed.join(crowded, same_keys(placed, crowded, by), "left_anti")
    raw = placed.select(
        *keys, F.lit(0).alias("_level"), "_bucket", "_t",
        F.lit(1).cast("long").alias("_n"), F.col("_v").alias("_sum"), F.col("_v").alias("_max"),
    )
    table = raw.unionByName(grids.withColumn("_t", F.lit(None).cast("long")))
    on = (pieces["_level"] == table["_level"]) & (pieces["_bucket"] == table["_bucket"])
    if keys:
        on = on & same_keys(pieces, table, keys)
    inside = pieces["_lo"].isNull() | ((table["_t"] >= pieces["_lo"]) & (table["_t"] < pieces["_hi"]))
    matched = pieces.join(table, on & inside).select("_span", "_n", "_sum", "_max")
    return [matched, *finer]
