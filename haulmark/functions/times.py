"""Calendar expressions. All timestamps are UTC wall-clock values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = dt.date | str


def utc_timestamp(text: Column) -> Column:
    """Parse text (with or without an offset) to a UTC wall clock; unreadable text is NULL."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(ts: Column) -> Column:
    """Monday of the week of ``ts``."""
    day = F.to_date(ts)
    return F.date_sub(day, F.weekday(day))


def week_end(monday: Column) -> Column:
    return F.date_add(monday, 6)


def prior_week(monday: Column) -> Column:
    return F.date_sub(monday, 7)


def iso_week_label(day: Column) -> Column:
    """``2024-12-30`` is in ``2025-W01``."""
    label = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    return F.when(day.isNotNull(), label)


def delay_days(delivered: Column, estimated: Column) -> Column:
    """Signed fractional days between promise and delivery; NULL while either is missing."""
    return F.timestamp_diff("MICROSECOND", estimated, delivered) / F.lit(86_400e6)


def late_flag(delay: Column) -> Column:
    """A missing delay counts as on time."""
    return F.coalesce(delay > 0, F.lit(False))


def days_until(estimated: Column, as_of: Column) -> Column:
    """Whole days left, rounded towards the past."""
    return F.floor(F.timestamp_diff("MICROSECOND", as_of, estimated) / F.lit(86_400e6)).cast("bigint")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("smallint")


def month(ts: Column) -> Column:
    return F.month(ts).cast("smallint")


def monday_of(day: Day) -> dt.date:
    """Driver-side Monday for a report argument."""
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return day - dt.timedelta(days=day.weekday())


def time_literal(df: DataFrame, column: str, value: dt.date | dt.datetime | str) -> Column:
    """``value`` typed like ``column``, so the comparison can be pushed to the file scan."""
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast(df.schema[column].dataType)
