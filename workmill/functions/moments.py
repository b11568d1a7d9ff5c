"""Time arithmetic on zone-less timestamps.

All warehouse times are UTC wall-clock values in TIMESTAMP_NTZ, so nothing here
depends on the session zone and comparisons reach the parquet scan unchanged.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(as_of: datetime | date | str) -> datetime:
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    return as_of


def at(as_of: datetime | date | str | Column) -> Column:
    """A timestamp literal; its type matches the columns so filters push down."""
    if isinstance(as_of, Column):
        return as_of
    return F.expr(f"TIMESTAMP_NTZ '{parse(as_of):%Y-%m-%d %H:%M:%S.%f}'")


def on(as_of: datetime | date | str | Column) -> Column:
    """The calendar day of `as_of` as a date literal."""
    if isinstance(as_of, Column):
        return F.to_date(as_of)
    return F.expr(f"DATE '{parse(as_of):%Y-%m-%d}'")


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds with microseconds, DECIMAL(18,6)."""
    return (end - start).cast("interval second").cast("decimal(18,6)")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes: seconds rounded half away from zero, then integer division."""
    seconds = F.round(seconds_between(start, end), 0).cast("int")
    return F.call_function("div", seconds, F.lit(60)).cast("int")


def whole_days(ts: Column, today: Column) -> Column:
    """Complete 24-hour blocks from `ts` to the start of `today`, toward zero.

    Not a calendar-day difference: from 10:00 on Monday to Wednesday is 1.
    """
    return F.extract(F.lit("DAY"), today - ts).cast("int")


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def since(ts: Column, hours: int, as_of) -> Column:
    """Look-back predicate: ts >= as_of - hours."""
    if isinstance(as_of, Column):
        return ts >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return ts >= at(parse(as_of) - timedelta(hours=hours))
