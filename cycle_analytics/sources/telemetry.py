"""CSV and JSON-lines telemetry with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics import schemas
from cycle_analytics.functions.clock import local_from_millis, on_date, wall_clock

MISSING = "-"


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header line; blanks are NULL and padding is dropped."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )


def backup_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.BACKUP).withColumn("ended_at", wall_clock(F.col("timestamp")))


def restore_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RESTORE).withColumn("ended_at", wall_clock(F.col("timestamp")))


def workflow_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.WORKFLOW).withColumn("ended_at", wall_clock(F.col("timestamp")))


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema).withColumn("ts", wall_clock(F.col("timestamp"))).drop("timestamp")


def operation_log(spark: SparkSession, path: str) -> DataFrame:
    return snapshots(spark, path, schemas.OPERATION_LOG)


def monitor_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines system samples, nested fields kept."""
    return spark.read.schema(schemas.MONITOR).json(path).withColumn("ts", wall_clock(F.col("timestamp")))


def _metric(spark: SparkSession, path: str | list[str], dims: list[str]) -> DataFrame:
    """A chart with its dimensions named by position, all read as text.

    Positions settle repeated header names, and text keeps a time of day from turning
    into today's date.
    """
    ddl = ", ".join(f"`{c}` string" for c in ["clock", *dims, "anomaly", "annotations"])
    df = read_csv(spark, path, ddl)
    name = F.col("_metadata.file_name")
    return df.withColumns(
        {
            "host": F.when(name.startswith("p-") | name.rlike(r"_p\.csv$"), "primary").otherwise("backup"),
            "chart": F.regexp_replace(
                F.regexp_replace(name, r"(_p)?\.csv$", ""), r"^[pr]-|-(converted|raw)$", ""
            ),
        }
    )


def converted_metric(
    spark: SparkSession, path: str | list[str], dims: list[str], run_date: str, null_policy: str = "drop"
) -> DataFrame:
    """A chart with time-of-day stamps; `drop` removes rows without any value, `zero` fills them."""
    df = _metric(spark, path, dims)
    values = {d: F.when(F.col(d) != MISSING, F.col(d)).try_cast("double") for d in dims}
    if null_policy == "zero":
        values = {d: F.coalesce(v, F.lit(0.0)) for d, v in values.items()}
    out = df.select("host", "chart", on_date(run_date, F.col("clock")).alias("ts"), *[v.alias(d) for d, v in values.items()])
    return out.dropna(how="all", subset=dims) if null_policy == "drop" else out


def raw_metric(spark: SparkSession, path: str | list[str], dims: list[str]) -> DataFrame:
    """A chart with epoch milliseconds and base units."""
    df = _metric(spark, path, dims)
    values = [F.when(F.col(d) != MISSING, F.col(d)).try_cast("double").alias(d) for d in dims]
    return df.select("host", "chart", local_from_millis(F.col("clock").try_cast("bigint")).alias("ts"), *values)
