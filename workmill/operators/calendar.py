"""The date dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.functions.moments import on
from workmill.functions.scalars import padded_name
from workmill.operators.lookup import UNKNOWN
from workmill.sources.schemas import schema

# The holidays of the loader.
HOLIDAYS = {
    "2023-01-01": "New Year's Day",
    "2023-01-16": "Martin Luther King Jr. Day",
    "2023-02-20": "Presidents' Day",
    "2023-05-29": "Memorial Day",
    "2023-07-04": "Independence Day",
    "2023-09-04": "Labor Day",
    "2023-10-09": "Columbus Day",
    "2023-11-10": "Veterans Day",
    "2023-11-23": "Thanksgiving Day",
    "2023-12-25": "Christmas Day",
}


def _columns(first: Column, holidays: Mapping[str, str]) -> dict[str, Column]:
    day = F.col("full_date")
    names = F.create_map(*[F.lit(x) for pair in holidays.items() for x in pair]) if holidays else None
    holiday = names[day.cast("string")] if holidays else F.lit(None).cast("string")
    sunday_based = F.dayofweek(day) - 1
    return {
        "time_key": F.date_diff(day, first) + 1,
        "full_date": day,
        "day_of_week": sunday_based,
        "day_name": padded_name(day, "EEEE"),
        "day_of_month": F.dayofmonth(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
        "month_number": F.month(day),
        "month_name": padded_name(day, "MMMM"),
        "quarter_number": F.quarter(day),
        "year_number": F.year(day),
        "is_weekend": sunday_based.isin(0, 6),
        "is_holiday": holiday.isNotNull(),
        "holiday_name": holiday,
        "effective_date": day,
        "expiry_date": F.lit(None).cast("date"),
        "is_current": F.lit(True),
    }


def _build(bounds: DataFrame, holidays: Mapping[str, str], unknown: bool) -> DataFrame:
    """One row per day of a one-row frame (first, last)."""
    target = schema("dim_time")
    days = bounds.select("first", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    cols = _columns(F.col("first"), holidays)
    dim = days.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in target])
    if unknown:
        # Facts use key -1 for "no such date"; the extra member keeps the
        # reference to it valid.
        values = {"time_key": UNKNOWN, "is_weekend": False, "is_holiday": False, "is_current": True}
        row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in target]
        dim = dim.unionByName(bounds.select(*row))
    return dim


def dim_time(
    spark: SparkSession,
    start: str = "2020-01-01",
    end: str = "2030-12-31",
    holidays: Mapping[str, str] = HOLIDAYS,
    unknown: bool = False,
) -> DataFrame:
    """One row per day from `start` to `end`; keys count from 1 by date."""
    return _build(spark.range(1).select(on(start).alias("first"), on(end).alias("last")), holidays, unknown)


def dim_time_covering(df: DataFrame, ts: str, holidays: Mapping[str, str] = HOLIDAYS) -> DataFrame:
    """The date dimension over whole years that hold every `ts` of `df`."""
    bounds = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        F.trunc(F.to_date("lo"), "YEAR").alias("first"),
        F.date_sub(F.add_months(F.trunc(F.to_date("hi"), "YEAR"), 12), 1).alias("last"),
    )
    return _build(bounds, holidays, unknown=False)
