"""Registry of the queries over the parquet tables and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.session import use_wall_clock

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            use_wall_clock(spark)
            return fn(spark, root)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return run

    return register


def cents(amount: Column | str) -> Column:
    """Two-digit amounts as whole hundredths, so that sums are exact."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.round(value * 100).cast("bigint")


def padded_id(number: Column | str) -> Column:
    """Numbers as fixed-width text, whose order is the numeric order."""
    value = F.col(number) if isinstance(number, str) else number
    return F.lpad(value.cast("string"), 12, "0")
