"""Time columns: microseconds, periods and whole-unit differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwise.model import HOUR_US

# Names and short forms of the calendar periods.
PERIOD_UNITS = {
    "hourly": "hour",
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "hours": "hour",
    "days": "day",
    "weeks": "week",
    "months": "month",
    "1h": "hour",
    "1d": "day",
    "1w": "week",
    "1mo": "month",
}
# Units of durations, in months and in nanoseconds.
MONTHS = {"mo": 1, "q": 3, "y": 12}
NANOS = {
    "ns": 1,
    "us": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
    "d": 86_400_000_000_000,
    "w": 604_800_000_000_000,
}


def micros(timestamp: Column | str) -> Column:
    """Event time as microseconds since the epoch (the session runs in UTC)."""
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.unix_micros(timestamp.cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(us).cast("timestamp_ntz")


def period_spec(period: str) -> tuple[str, str | int]:
    """('trunc', unit) for calendar periods, ('window', microseconds) or, in whole weeks,
    ('weeks', microseconds) for fixed durations, and ('months', number) for multiples of
    months, quarters and years.

    Durations may be compound: amounts of units of a fixed length add up (``1d12h``), and so
    do months, quarters and years (``1y2q``).  The two kinds do not mix, as a month has no
    length, and a period is a whole number of microseconds, the precision of the times.
    """
    unit = PERIOD_UNITS.get(period.lower())
    if unit:
        return "trunc", unit
    if not re.fullmatch(r"(\d+(mo|ms|us|ns|[smhdwqy]))+", period):
        raise ValueError(f"unknown aggregation period: {period!r}")
    amounts = [(int(n), u) for n, u in re.findall(r"(\d+)(mo|ms|us|ns|[smhdwqy])", period)]
    units = {u for _, u in amounts}
    if units <= set(MONTHS):
        kind, total = "months", sum(n * MONTHS[u] for n, u in amounts)
    elif units <= set(NANOS):
        total, rest = divmod(sum(n * NANOS[u] for n, u in amounts), 1_000)
        kind = "weeks" if units == {"w"} else "window"
        if rest:
            raise ValueError(f"aggregation period finer than a microsecond: {period!r}")
    else:
        raise ValueError(f"aggregation period mixes months with fixed lengths: {period!r}")
    if not total:
        raise ValueError(f"empty aggregation period: {period!r}")
    return kind, total


def period_start(timestamp: Column | str, period: str) -> Column:
    """Start of the period holding the timestamp."""
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    kind, value = period_spec(period)
    if kind == "trunc":
        return F.date_trunc(value, timestamp).cast("timestamp_ntz")
    if kind == "months":
        # Counted from the year 0, so that quarters and years begin where the calendar's do.
        month = F.year(timestamp) * 12 + F.month(timestamp) - 1
        first = month - F.pmod(month, F.lit(value))
        year = F.call_function("div", first, F.lit(12)).cast("int")
        day = F.make_date(year, (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1))
        return day.cast("timestamp_ntz")
    # Week multiples start on a Monday, like the calendar week; 1970-01-05 was one.
    origin = 4 * 24 * HOUR_US if kind == "weeks" else 0
    us = micros(timestamp) - origin
    return from_micros(us - F.pmod(us, F.lit(value).cast("bigint")) + origin)


def period_end(start: Column | str, period: str, legacy_month: bool = False) -> Column:
    """Exclusive end of a period; ``legacy_month`` makes every month 30 days long."""
    start = F.col(start) if isinstance(start, str) else start
    kind, value = period_spec(period)
    if kind in ("window", "weeks"):
        return from_micros(micros(start) + F.lit(value).cast("bigint"))
    if kind == "months":
        return (start + F.make_ym_interval(F.lit(0), F.lit(value))).cast("timestamp_ntz")
    if value == "month":
        step = F.make_dt_interval(days=F.lit(30)) if legacy_month else F.make_ym_interval(
            F.lit(0), F.lit(1)
        )
        return (start + step).cast("timestamp_ntz")
    days, hours = {"hour": (0, 1), "day": (1, 0), "week": (7, 0)}[value]
    return start + F.make_dt_interval(F.lit(days), F.lit(hours))


def whole_seconds(us: Column) -> Column:
    """Complete seconds in a microsecond difference, truncated towards zero."""
    return F.call_function("div", us, F.lit(1_000_000))


def whole_hours(us: Column) -> Column:
    return F.call_function("div", us, F.lit(HOUR_US))


def seconds_as_hours(us: Column) -> Column:
    return whole_seconds(us) / F.lit(3600)
