"""Column helpers for time: every operator takes ``as_of`` instead of the wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def instant(value: datetime | str | Column) -> Column:
    """A zone-free timestamp literal; keeps scan filters pushable on NTZ columns."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_us(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(float(MICROS))


def bucket(unit: str, c: Column | str) -> Column:
    """Calendar bucket start (hour, day, ISO week, month) without a zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc(unit, c.cast("timestamp")).cast("timestamp_ntz")


def last(c: Column | str, as_of, amount: int, unit: str) -> Column:
    """``as_of - amount unit <= c <= as_of`` with constant bounds."""
    c = F.col(c) if isinstance(c, str) else c
    end = instant(as_of)
    return (c >= end - F.expr(f"INTERVAL {int(amount)} {unit}")) & (c <= end)


# Named ranges of the public query interface, as (amount, unit) back from
# ``as_of`` or a calendar unit that ``as_of`` falls into.
TIME_PRESETS = {
    "last_hour": (1, "HOUR"),
    "last_24h": (24, "HOUR"),
    "last_7d": (7, "DAY"),
    "last_30d": (30, "DAY"),
    "this_week": "week",
    "this_month": "month",
}


def preset(c: Column | str, name: str, as_of) -> Column:
    spec = TIME_PRESETS[name]
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(spec, tuple):
        return last(c, as_of, spec[0], spec[1])
    return (c >= bucket(spec, instant(as_of))) & (c <= instant(as_of))
