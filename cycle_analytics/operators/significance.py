"""Welch's unequal-variance t-test between two groups of one frame, once or for every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.functions.student_t import two_sided_p


def welch(df: DataFrame, group: str, value: str, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """Counts, means, t and degrees of freedom, one row or one per key. One pass with partial aggregates."""

    def of(name: str, fn) -> Column:
        return fn(F.when(F.col(group) == name, F.col(value)))

    measures = [
        of(first, F.count).alias("n_1"), of(first, F.avg).alias("mean_1"), of(first, F.var_samp).alias("var_1"),
        of(second, F.count).alias("n_2"), of(second, F.avg).alias("mean_2"), of(second, F.var_samp).alias("var_2"),
    ]
    moments = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    e1, e2 = F.try_divide("var_1", "n_1"), F.try_divide("var_2", "n_2")
    squares = F.try_divide(e1 * e1, F.col("n_1") - 1) + F.try_divide(e2 * e2, F.col("n_2") - 1)
    return moments.select(
        *(keys or []), "n_1", "mean_1", "n_2", "mean_2",
        F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(e1 + e2)).alias("t"),
        F.try_divide((e1 + e2) * (e1 + e2), squares).alias("df"),
    )


def welch_with_p(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add the p-value and the decision to every row of `welch`; both are NULL where t is."""
    p = two_sided_p(F.col("t"), F.col("df"))
    return tested.withColumn("p", p).withColumn("significant", F.col("p") < alpha)
