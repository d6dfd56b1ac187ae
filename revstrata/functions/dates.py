"""Dates and times. Session time zone: UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"
UNITS = ("hour", "day", "week", "month")


def iso_of_millis(ms: Column) -> Column:
    """Epoch milliseconds as 2011-01-01T00:00:00; null of null."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), ISO)


def day_of_millis(ms: Column) -> Column:
    """Epoch milliseconds as 20110101; null of anything that isn't a number."""
    return F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyyMMdd")


def hour_to_day(s: Column) -> Column:
    """2011010123 as 20110101; other input is an error."""
    return F.date_format(F.to_timestamp(s, "yyyyMMddHH"), "yyyyMMdd")


def next_day(s: Column) -> Column:
    """The day after yyyyMMdd, in the same form."""
    return F.date_format(F.date_add(F.to_date(s, "yyyyMMdd"), 1), "yyyyMMdd")


def parse_iso(s: Column) -> Column:
    """2011-01-01T00:00:00Z as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def print_iso(ts: Column) -> Column:
    return F.date_format(ts, ISO + "'Z'")


def bucket(ts: Column, unit: str) -> Column:
    """The begin of the hour, day, week (Monday) or month."""
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {UNITS}")
    return F.date_trunc(unit, ts)


def ceiling(ts: Column, unit: str) -> Column:
    """The end of the bucket: ts itself where it is a boundary."""
    low = bucket(ts, unit)
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[unit]
    return F.when(low == ts, ts).otherwise(low + F.expr(step))


def log_time(s: Column) -> Column:
    """10/Oct/2000:13:55:36 -0700 as epoch milliseconds; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(s, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def millis(value: str | int) -> int:
    """A window bound: epoch milliseconds, or ISO 8601."""
    from datetime import UTC, datetime

    if isinstance(value, int) or value.lstrip("-").isdigit():
        return int(value)
    at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)
