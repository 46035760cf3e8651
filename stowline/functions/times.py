"""Instants, ages and cycle arithmetic. `now` is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from stowline.fixed_values import CYCLE_PATTERN, REQUEST_DATE_FORMAT, REQUEST_TIME_FORMAT

_ISO_INSTANT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"
_NO_SECONDS = "(T[0-9]{2}:[0-9]{2})(Z|[+-])"


def as_utc(moment: datetime | str) -> datetime:
    value = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def instant(moment: datetime | str) -> Column:
    """A UTC timestamp literal."""
    return F.lit(as_utc(moment).isoformat(sep=" ")).cast("timestamp")


def like_column(df: DataFrame, column: str, moment: datetime | str) -> Column:
    """A literal of the column's own type, so that a comparison reaches the scan without a cast."""
    return F.lit(as_utc(moment).isoformat(sep=" ")).cast(df.schema[column].dataType)


def days_before(now: datetime | str, days: int) -> datetime:
    return as_utc(now) - timedelta(days=days)


def parse_instant(text: Column) -> Column:
    """ISO instants with optional seconds, fraction and any offset form; NULL for other text."""
    text = F.trim(text)
    full = F.regexp_replace(text, _NO_SECONDS, "$1:00$2")
    return F.when(text.rlike(_ISO_INSTANT), full.try_cast("timestamp"))


def _combined(date: Column, time: Column, pattern: str) -> Column:
    text = F.concat_ws(" ", date, time)
    return F.when(text.rlike(pattern), text.try_cast("timestamp"))


def parse_minute(date: Column, time: Column) -> Column:
    """`yyyy-MM-dd` and `HH:mm`; NULL for other text and impossible dates."""
    return _combined(date, time, "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}$")


def parse_millisecond(date: Column, time: Column) -> Column:
    """`yyyy-MM-dd` and `HH:mm:ss.SSS`; NULL for other text and impossible dates."""
    return _combined(date, time, "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}$")


def parse_day(text: Column) -> Column:
    """Calendar day of the first ten characters, NULL when they are none."""
    head = F.left(F.trim(text), F.lit(10))
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head.try_cast("date"))


def request_date(moment: Column) -> Column:
    return F.date_format(moment, REQUEST_DATE_FORMAT)


def request_time(moment: Column) -> Column:
    return F.date_format(moment, REQUEST_TIME_FORMAT)


def age_days(moment: Column, now: datetime | str) -> Column:
    """Whole days from `moment` to `now`, cut down."""
    return F.timestamp_diff("DAY", moment.cast("timestamp"), instant(now))


def cycle_date(name: Column) -> Column:
    """Date in a cycle-directory name; NULL for other names and impossible dates."""
    digits = F.regexp_extract(name, CYCLE_PATTERN, 1)
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


def days_left(cycle: Column, now: datetime | str) -> Column:
    """Whole days from `now` to the cycle day's midnight, rounded down."""
    seconds = F.unix_timestamp(cycle.cast("timestamp")) - F.unix_timestamp(instant(now))
    return F.floor(seconds / F.lit(86400)).cast("bigint")
