"""Dates, clocks and ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayzero.constants import LAST_MINUTE

DateLike = str | dt.date
TimeLike = str | dt.date | dt.datetime


def as_date(value: DateLike) -> Column:
    return F.to_date(F.lit(str(value)))


def as_timestamp(value: TimeLike) -> Column:
    """A literal without time zone: it compares as is with zone-less columns
    and is read in the session zone (UTC) against zoned ones."""
    return F.to_timestamp_ntz(F.lit(str(value)))


def days_after(value: DateLike, days: int) -> dt.date:
    return dt.date.fromisoformat(str(value)[:10]) + dt.timedelta(days=days)


def next_midnight(value: TimeLike) -> dt.date:
    """The end of the last day that starts before ``value``."""
    moment = dt.datetime.fromisoformat(str(value))
    return moment.date() + dt.timedelta(days=moment.time() > dt.time())


def date_range(
    column: str, first: DateLike | None = None, last: DateLike | None = None
) -> Column:
    """Closed day range; an open end is left out, a fully open one is true."""
    wanted = F.lit(True)
    if first is not None:
        wanted = wanted & (F.col(column) >= as_date(first))
    if last is not None:
        wanted = wanted & (F.col(column) <= as_date(last))
    return wanted


def time_range(
    column: str, start: TimeLike | None = None, before: TimeLike | None = None
) -> Column:
    """Half-open time range ``[start, before)``."""
    wanted = F.lit(True)
    if start is not None:
        wanted = wanted & (F.col(column) >= as_timestamp(start))
    if before is not None:
        wanted = wanted & (F.col(column) < as_timestamp(before))
    return wanted


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(end, start)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Whole minutes, cut toward zero: 59 s is 0, minus 90 s is -1."""
    return F.timestamp_diff("MINUTE", _column(start), _column(end))


def epoch_to_date(seconds: Column) -> Column:
    """UTC day of an epoch second, whatever the session zone is."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def week_of_year(day: str | Column) -> Column:
    """Week 0-53 with weeks starting on Sunday; days before the first Sunday
    are week 0.  (Spark's ``weekofyear`` is the ISO week.)"""
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")


def usable_minutes(
    time: str | Column, last_minute: int = LAST_MINUTE, every_hour: bool = True
) -> Column:
    """Rows up to ``last_minute`` of *every* hour, which is what the reports
    count; ``every_hour=False`` cuts only the end of the day."""
    early = F.minute(time) <= last_minute
    return early if every_hour else (F.hour(time) < 23) | early


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
