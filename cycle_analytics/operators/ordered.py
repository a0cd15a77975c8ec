"""Running values over an ordered group, for groups of any size.

A window keyed by chain, host or user puts each group in one task. That is right
while groups are small. A group above `hot_rows` rows - fewer, the wider the rows
are - (and every group when there is no key at all) takes a second way:

1. range-partition the rows by (keys, order), so that a group spans many blocks;
2. run the window inside each (group, block);
3. add the carry of the earlier blocks, taken from one summary row per (group, block).

Both ways give the same values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cycle_analytics.session import is_small, tasks_for, written

HOT_ROWS = 5_000_000
BLOCK_BYTES = 256 * 1024 * 1024
# What a task of whole groups has of the files: in memory, as rows of a window or an aggregate, it is 30 times as much.
GROUP_BYTES = 8 * 1024 * 1024
_BLOCK = "_block"


@dataclass(frozen=True)
class Measure:
    """One running value: kind is `number`, `sum`, `max` or `previous`."""

    kind: str
    value: Column | None = None


def number() -> Measure:
    """1-based position in the group."""
    return Measure("number")


def total(value: Column) -> Measure:
    """Sum of all rows up to and including this one."""
    return Measure("sum", value)


def peak(value: Column) -> Measure:
    """Largest value among all rows up to and including this one."""
    return Measure("max", value)


def previous(value: Column) -> Measure:
    """Value of the row before this one, NULL on the first row."""
    return Measure("previous", value)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than `hot_rows` rows: at most rows / hot_rows of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > hot_rows).drop("_n")


def hot_limit(df: DataFrame) -> int:
    """Rows of a group that are left to one task: what a block holds of rows of this width."""
    return min(HOT_ROWS, max(1, BLOCK_BYTES // df._jdf.schema().defaultSize()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, Measure],
    hot_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add the running `measures` to `df`.

    `order` must be a total order inside a group. `split` forces or forbids the
    second way; by default it follows the size estimate and the group sizes.
    """
    staged = df.select("*", *[m.value.alias(f"_in_{name}") for name, m in measures.items() if m.value is not None])
    if split is None:
        split = not is_small(df)
    if not split:
        return _in_groups(staged, keys, order, measures)
    if not keys:
        return _in_blocks(staged, keys, order, measures)
    hot = written(hot_groups(df, keys, hot_rows or hot_limit(staged)), "hot-groups")
    tasks = tasks_for(df, GROUP_BYTES)
    if hot.isEmpty():
        return _in_groups(staged, keys, order, measures, tasks)
    cold_rows = staged.join(hot, same_keys(staged, hot, keys), "left_anti")
    hot_rows_df = staged.join(hot, same_keys(staged, hot, keys), "left_semi")
    return _in_groups(cold_rows, keys, order, measures, tasks).unionByName(
        _in_blocks(hot_rows_df, keys, order, measures)
    )


def _windowed(name: str, measure: Measure, by: list[str], order: list[str]) -> Column:
    ranked = Window.partitionBy(*by).orderBy(*order)
    frame = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = F.col(f"_in_{name}")
    if measure.kind == "number":
        return F.row_number().over(ranked).cast("long")
    if measure.kind == "sum":
        return F.sum(source).over(frame)
    if measure.kind == "max":
        return F.max(source).over(frame)
    return F.lag(source).over(ranked)


def _in_groups(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Measure], tasks: int | None = None
) -> DataFrame:
    """Plain windows. A number of tasks holds: left to itself Spark joins partitions by their compressed bytes."""
    dealt = df.repartition(tasks, *keys) if tasks else df
    out = dealt.select("*", *[_windowed(n, m, keys, order).alias(n) for n, m in measures.items()])
    return out.drop(*[f"_in_{n}" for n in measures])


def block_count(df: DataFrame) -> int:
    """Blocks for the rows of a frame."""
    return tasks_for(df, BLOCK_BYTES)


def _in_blocks(df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Measure]) -> DataFrame:
    ranged = df.repartitionByRange(block_count(df), *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    rows = written(ranged, "ordered-blocks")

    by = [*keys, _BLOCK]
    inside = rows.select("*", *[_windowed(n, m, by, order).alias(n) for n, m in measures.items()])

    position = F.struct(*order)
    summaries = {
        "number": lambda n: F.count(F.lit(1)),
        "sum": lambda n: F.sum(f"_in_{n}"),
        "max": lambda n: F.max(f"_in_{n}"),
        "previous": lambda n: F.max_by(F.struct(F.col(f"_in_{n}").alias("v")), position),
    }
    summary = rows.groupBy(*by).agg(*[summaries[m.kind](n).alias(f"_out_{n}") for n, m in measures.items()])

    earlier = Window.partitionBy(*keys).orderBy(_BLOCK)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carries = {
        "number": lambda n: F.coalesce(F.sum(f"_out_{n}").over(before), F.lit(0)),
        "sum": lambda n: F.sum(f"_out_{n}").over(before),
        "max": lambda n: F.max(f"_out_{n}").over(before),
        "previous": lambda n: F.lag(f"_out_{n}").over(earlier),
    }
    carry = summary.select(
        *[F.col(k).alias(f"_key_{k}") for k in by],
        *[carries[m.kind](n).alias(f"_carry_{n}") for n, m in measures.items()],
    )
    matches = reduce(lambda a, b: a & b, [inside[k].eqNullSafe(carry[f"_key_{k}"]) for k in by])
    joined = inside.join(carry, matches, "left")

    first_in_block = Window.partitionBy(*by).orderBy(*order)
    if any(m.kind == "previous" for m in measures.values()):
        joined = joined.withColumn("_first", F.row_number().over(first_in_block) == 1)

    def merged(name: str, measure: Measure) -> Column:
        here, carried = F.col(name), F.col(f"_carry_{name}")
        if measure.kind == "number":
            return here + carried
        if measure.kind == "sum":
            return F.when(carried.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carried)
        if measure.kind == "max":
            return F.greatest(here, carried)
        return F.when(F.col("_first"), carried["v"]).otherwise(here)

    kept = [c for c in df.columns if not c.startswith("_in_")]
    return joined.select(*kept, *[merged(n, m).alias(n) for n, m in measures.items()])
