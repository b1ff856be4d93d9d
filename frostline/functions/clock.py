"""Wall-clock arithmetic.

All business times are local wall clock without a zone, so nothing here may depend on the session time zone:
text is read as TIMESTAMP_NTZ and differences are taken from calendar fields.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def local_ts(text: Column) -> Column:
    """First 19 characters as TIMESTAMP_NTZ; a trailing UTC offset is ignored, an impossible clock gives NULL."""
    return F.substring(text, 1, 19).try_cast("timestamp_ntz")


def local_date(text: Column) -> Column:
    return local_ts(text).cast("date")


def on_days(name: str, first: date, last: date | None = None) -> Column:
    """Whether the local start in a column lies on the days from ``first`` to ``last`` (open when None).

    The range of the raw ISO text stands beside the exact condition: it reaches the Parquet statistics.
    """
    text, exact = F.col(name), local_date(F.col(name)) >= day(first)
    raw = text >= first.strftime("%Y-%m-%d")
    if last is None:
        return raw & exact
    until = (last + timedelta(days=1)).strftime("%Y-%m-%d")
    return raw & (text < until) & exact & (local_date(text) <= day(last))


def ntz(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def day(moment: datetime | date) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d")).cast("date")


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 on the wall clock of ``ts`` (no zone conversion)."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY_SECONDS + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_wall_seconds(moment: datetime) -> int:
    return int((moment - datetime(1970, 1, 1)).total_seconds())


def whole_minutes(seconds: Column) -> Column:
    """Minutes truncated toward zero, so 30 seconds late is still 0."""
    return (F.signum(seconds) * F.floor(F.abs(seconds) / 60)).cast("int")


def minutes_until(deadline: Column, as_of: datetime) -> Column:
    return whole_minutes(wall_seconds(deadline) - F.lit(epoch_wall_seconds(as_of)))


def plus_minutes(ts: Column, minutes: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, minutes, zero)


def iso_seconds(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``; built from the text form, which needs no time zone."""
    return F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T")


def compact_date(d: Column) -> Column:
    """``yyyyMMdd`` from the ISO text of a date (no formatter, no time zone)."""
    return F.replace(d.cast("string"), F.lit("-"))


def month_of(d: Column) -> Column:
    """``yyyy-MM`` from the ISO text of a date."""
    return F.substring(d.cast("string"), 1, 7)
