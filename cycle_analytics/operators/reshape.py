"""Wide charts to long form, with unit conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Recorded unit, shown unit, divisor.
UNITS = [
    ("mebibytes", "GiBy", 1024.0),
    ("kibibytes", "MiBy", 1024.0),
    ("kibibytes per second", "MiBy/s", 1024.0),
    ("kilobits per second", "Gbit/s", 1_000_000.0),
    ("packets per second", "K packets/s", 1000.0),
    ("faults per second", "K faults/s", 1000.0),
    ("percent", "%", 1.0),
    ("threads", "threads", 1.0),
]


def unit_table(spark: SparkSession) -> DataFrame:
    """The fixed units. A constant of a few rows goes to every task: a few units make few keys, and a shuffle by them few large tasks."""
    return F.broadcast(spark.createDataFrame(UNITS, "unit string, shown_unit string, divisor double"))


def wide_to_long(df: DataFrame, ids: list[str], dims: dict[str, str], units: dict[str, str]) -> DataFrame:
    """One row per dimension; `dims` maps column to name, `units` column to unit."""
    columns = list(dims)
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, "_column", "value")
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, dims[c])])
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, units[c])])
    return long.select(*ids, names[F.col("_column")].alias("dim"), kinds[F.col("_column")].alias("unit"), "value")


def shown(long: DataFrame, units: DataFrame, digits: int = 4) -> DataFrame:
    """Values in display units; units without an entry stay as they are. Spark sizes the join."""
    return (
        long.join(units, "unit", "left")
        .withColumn("shown_value", F.round(F.col("value") / F.coalesce("divisor", F.lit(1.0)), digits))
        .withColumn("shown_unit", F.coalesce("shown_unit", "unit"))
        .drop("divisor")
    )
