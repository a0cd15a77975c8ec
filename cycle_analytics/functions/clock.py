"""Stamps: offsets are stripped, not converted, and the date is always kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone of stamps that carry no offset.
DEFAULT_ZONE = "Asia/Jakarta"

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def wall_clock(text: Column) -> Column:
    """ISO stamp to local wall clock; `...T01:59:27+07:00` stays 01:59:27."""
    return F.trim(text).try_cast("timestamp_ntz")


def instant(text: Column, zone: str = DEFAULT_ZONE) -> Column:
    """ISO stamp to an instant; a stamp without offset belongs to `zone`."""
    stamp = F.trim(text)
    return F.when(stamp.rlike(_OFFSET), stamp.try_cast("timestamp")).otherwise(
        F.to_utc_timestamp(stamp.try_cast("timestamp"), zone)
    )


def on_date(run_date: Column | str, time_of_day: Column) -> Column:
    """Time of day plus run date."""
    day = F.lit(run_date) if isinstance(run_date, str) else run_date
    return F.concat(day, F.lit(" "), F.trim(time_of_day)).try_cast("timestamp_ntz")


def local_from_millis(epoch_ms: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Epoch milliseconds to the wall clock of `zone`."""
    return F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone).cast("timestamp_ntz")


def seconds(amount: Column) -> Column:
    """A duration of `amount` seconds, exact to the microsecond."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), amount.cast("decimal(18,6)"))


def span_start(end: Column, duration_s: Column) -> Column:
    """Start of a span recorded by its end and duration."""
    return end - seconds(duration_s)


def hour_minute(stamp: Column) -> Column:
    return F.date_format(stamp, "HH:mm")


def time_of_day(stamp: Column) -> Column:
    return F.date_format(stamp, "HH:mm:ss")
