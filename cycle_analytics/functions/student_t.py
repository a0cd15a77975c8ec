"""Two-sided p-values of Student's t as column expressions, for any number of tests in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
SHIFTED = 8
# Bernoulli terms of the logarithm of the gamma function, highest power first.
STIRLING = (-691.0 / 360360.0, 1.0 / 1188.0, -1.0 / 1680.0, 1.0 / 1260.0, -1.0 / 360.0, 1.0 / 12.0)
LEAST_STEPS = 200


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, stepped back by the recurrence."""
    y = x + SHIFTED
    square, series = 1.0 / (y * y), F.lit(0.0)
    for term in STIRLING:
        series = series * square + term
    product = x
    for k in range(1, SHIFTED):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y - F.log(product)


def _kept_off_zero(value: Column) -> Column:
    return F.when(F.abs(value) > TINY, value).otherwise(F.lit(TINY))


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by modified Lentz steps.

    It settles after some multiple of the root of the larger parameter; steps beyond that change nothing.
    """
    steps = (F.lit(LEAST_STEPS) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int")
    first = 1.0 / _kept_off_zero(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1.0 / _kept_off_zero(1.0 + even * state["d"])
        c1 = _kept_off_zero(1.0 + even / state["c"])
        d2 = 1.0 / _kept_off_zero(1.0 + odd * d1)
        c2 = _kept_off_zero(1.0 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (state["f"] * c1 * d1 * c2 * d2).alias("f"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step)["f"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; one fraction, on whichever side it settles fast."""
    low = x < (a + 1.0) / (a + b + 2.0)
    p, q, at = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1.0 - x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    # Finished values first: the fraction refers to them in every step.
    rows = F.array(F.struct(p.alias("p"), q.alias("q"), at.alias("at")))
    part = front * F.transform(rows, lambda r: beta_fraction(r["p"], r["q"], r["at"]))[0] / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, part).otherwise(1.0 - part)


def two_sided_p(t: Column, df: Column) -> Column:
    """NULL where t or the degrees of freedom are unknown."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(t.isNotNull() & (df > 0), incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))
