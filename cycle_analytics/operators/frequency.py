"""Counts, shares and time buckets of an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.operators.grid import regular_grid


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """Count, percentage and grand total per value; missing values are left out."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.select(F.sum("n")).scalar()
    return counts.withColumn("total", everything).withColumn("pct", F.col("n") / F.col("total") * 100)


def frequency_table(df: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """`frequencies` in order of the count, ties by value."""
    order = F.asc("n") if ascending else F.desc("n")
    return frequencies(df, key).orderBy(order, key)


def aligned_to(series: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Bring a series into the key set of another."""
    return keys.join(series, key, "left")


def bucket_counts(df: DataFrame, ts: str, key: str, minutes: int = 5) -> DataFrame:
    """Rows per key and clock-aligned bucket."""
    window = F.window(ts, f"{minutes} minutes")
    return df.where(F.col(key).isNotNull()).groupBy(window.alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_w.start").alias("bucket"), key, "n"
    )


def zero_filled(counts: DataFrame, key: str, minutes: int = 5) -> DataFrame:
    """Add the empty buckets between the first and the last bucket of each key."""
    ranges = counts.groupBy(key).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = regular_grid(ranges, "lo", "hi", 60 * minutes, [key], "bucket")
    return grid.join(counts, [key, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wide_counts(counts: DataFrame, key: str, values: list[str], minutes: int = 5) -> DataFrame:
    """One column per value, a row for every bucket inside the range of some value, gaps as 0."""
    filled = zero_filled(counts, key, minutes)
    wide = filled.groupBy("bucket").pivot(key, values).agg(F.sum("n"))
    return wide.select("bucket", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
