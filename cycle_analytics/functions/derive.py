"""Row-wise derivations: totals, residuals, rates, efficiency, gauges, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024**2
GIB = 1024**3

# Bytes that encryption adds, the slow-cycle line in seconds, the label of an exact restore.
NONCE_BYTES = 12
TAG_BYTES = 16
SLOW_SECONDS = 20
VALID = "✅ Valid"


def number_or(text: Column, null_policy: str = "drop") -> Column:
    """Text to number; unparseable is NULL (`drop`) or 0 (`zero`)."""
    value = F.trim(text).try_cast("double")
    return F.coalesce(value, F.lit(0.0)) if null_policy == "zero" else value


def row_sum(*parts: Column) -> Column:
    """Sum of the present parts; missing ones count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


def residual(whole: Column, *parts: Column) -> Column:
    """What the listed parts leave of the whole."""
    return whole - row_sum(*parts)


def mib(size: Column) -> Column:
    return size / F.lit(float(MIB))


def gib(size: Column) -> Column:
    return size / F.lit(float(GIB))


def per_second(amount: Column, duration_s: Column) -> Column:
    return F.try_divide(amount, duration_s)


def efficiency(stored: Column, raw: Column) -> Column:
    """Percent saved. 0 of 0 is 0; stored bytes without raw bytes have no ratio (NULL)."""
    nothing = (raw == 0) & (stored == 0)
    return F.when(nothing | raw.isNull() | stored.isNull(), 0.0).otherwise(
        (1 - F.try_divide(stored, raw)) * 100
    )


def ratio_undefined(stored: Column, raw: Column) -> Column:
    """Marks stored bytes without raw bytes."""
    return F.coalesce((raw == 0) & (stored != 0), F.lit(False))


def cpu_percent(user: Column, system: Column, softirq: Column, iowait: Column) -> Column:
    return user + system + softirq + iowait


def used_percent(used: Column, *others: Column) -> Column:
    """Share of `used` in the sum of all parts; an all-zero sum has no share."""
    whole = reduce(lambda a, b: a + b, [used, *others])
    return F.try_divide(used, F.nullif(whole, F.lit(0))) * 100


def gauge_percent(used: Column, whole: Column) -> Column:
    """Two-digit percentage, 0 when the whole is not positive."""
    return F.when(whole > 0, F.round(F.try_divide(used, whole) * 100, 2)).otherwise(0.0)


def busy_percent(idle_delta: Column, total_delta: Column) -> Column:
    """Busy share between two polls of cumulative counters, 0 when nothing was counted."""
    return F.when(total_delta > 0, F.round(100.0 * (1.0 - F.try_divide(idle_delta, total_delta)), 2)).otherwise(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def pair_mean(current: Column, before: Column) -> Column:
    """Mean of this row and the one before it, over those present."""
    both = (current + before) / 2
    return F.coalesce(both, current.cast("double"), before.cast("double"))


def short_chain(chain: Column) -> Column:
    return F.replace(chain, F.lit("chain-"), F.lit(""))


def cycle_label(chain: Column, n: Column, separator: str = "-") -> Column:
    return F.concat(short_chain(chain), F.lit(f"{separator}C"), n.cast("string"))


def cycle_name(n: Column) -> Column:
    return F.concat(F.lit("cycle-"), n.cast("string"))


def restore_status(difference: Column) -> Column:
    """Exact restores are valid; others show the difference, `nan` where there is none."""
    shown = F.coalesce(difference.cast("string"), F.lit("nan"))
    return F.when(difference == 0, VALID).otherwise(F.concat(F.lit("Delta ("), shown, F.lit(")")))


def is_slow(duration_s: Column, limit: float = SLOW_SECONDS) -> Column:
    return duration_s > F.lit(limit)


def encryption_overhead_ok(stored: Column, raw: Column) -> Column:
    return (stored - raw) == F.lit(NONCE_BYTES + TAG_BYTES)
