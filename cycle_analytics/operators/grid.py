"""Regular time grids with flagged gaps. No value is invented for a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS_A_BLOCK = 4096


def regular_grid(bounds: DataFrame, lo: str, hi: str, seconds: int, keys: list[str] | None = None, out: str = "slot") -> DataFrame:
    """One row per step from `lo` to `hi`; `bounds` has one row per key.

    Blocks of slots first, then the slots of each block: no row holds a whole grid, so a stamp far off makes many
    rows and never a giant one.
    """
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (lo, hi)]
    last = F.floor((micros[1] - micros[0]) / (seconds * 1_000_000)).cast("bigint")
    blocks = bounds.select(*(keys or []), F.col(lo).alias("_lo"), last.alias("_last")).where("_last >= 0").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / SLOTS_A_BLOCK)))
    )
    first = F.col("_block") * SLOTS_A_BLOCK
    slots = blocks.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_last"), first + SLOTS_A_BLOCK - 1))))
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_k") * seconds).cast("decimal(18,6)"))
    return slots.select(*(keys or []), (F.col("_lo") + offset).alias(out))


def padded(grid_bounds: DataFrame, lo: str, hi: str, seconds: int, before: int, after: int) -> DataFrame:
    """Move the bounds out by whole steps."""
    back, ahead = F.expr(f"interval {seconds * before} seconds"), F.expr(f"interval {seconds * after} seconds")
    return grid_bounds.withColumns({lo: F.col(lo) - back, hi: F.col(hi) + ahead})


def with_gaps(grid: DataFrame, series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The series on the grid; empty slots keep NULL and `is_imputed`."""
    return grid.join(series, [*keys, "slot"], "left").withColumn("is_imputed", F.col(value).isNull())


def around(real: DataFrame, before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """Union of the grid before, the real samples and the grid after."""
    empty = [
        part.withColumn(value, F.lit(None).cast("double")).withColumn("is_imputed", F.lit(True))
        for part in (before, after)
    ]
    return empty[0].unionByName(real.withColumn("is_imputed", F.lit(False))).unionByName(empty[1])
