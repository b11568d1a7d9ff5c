"""Scalar rules on hand-made rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from workmill.functions import crypto, moments, scalars
from workmill.functions.keys import assign_keys, fill_keys
from workmill.functions.measures import with_measures
from workmill.operators.calendar import dim_time


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_whole_days_are_24_hour_blocks(spark):
    days = lambda ts, today: one(spark, moments.whole_days(moments.at(ts), moments.on(today)))
    assert days("2024-01-01 10:00:00", "2024-01-03") == 1
    assert days("2024-01-01 00:00:00", "2024-01-03") == 2
    assert days("2024-01-05 01:00:00", "2024-01-03") == -2
    assert days("2024-01-03 23:00:00", "2024-01-03") == 0


def test_minutes_round_seconds_then_truncate(spark):
    minutes = lambda a, b: one(spark, moments.minutes_between(moments.at(a), moments.at(b)))
    assert minutes("2024-01-01 00:00:00", "2024-01-01 00:01:59.4") == 1
    assert minutes("2024-01-01 00:00:00", "2024-01-01 00:01:59.5") == 2
    assert minutes("2024-01-01 00:01:30", "2024-01-01 00:00:00") == -1


def test_durations_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # A daylight-saving change lies between the two.
        spent = one(spark, moments.seconds_between(moments.at("2024-03-09 12:00:00"), moments.at("2024-03-10 12:00:00")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spent == 86400


def test_size_pretty(spark):
    show = lambda n: one(spark, scalars.size_pretty(F.lit(n)))
    assert show(10239) == "10239 bytes"
    assert show(10240) == "10 kB"
    assert show(10 * 1024 + 511) == "10 kB"
    assert show(10 * 1024 + 512) == "11 kB"
    assert show(10 * 1024 * 1024) == "10 MB"
    assert show(3 * 1024**4) == "3072 GB"
    assert show(0) == "0 bytes"


def test_ratio_of_nothing_is_null(spark):
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalars.ratio(F.lit(1), F.lit(3))) == Decimal("33.33")


def test_distinct_from(spark):
    assert one(spark, scalars.distinct_from(F.lit(None).cast("int"), F.lit(None).cast("int"))) is False
    assert one(spark, scalars.distinct_from(F.lit(None).cast("int"), F.lit(1))) is True


def test_calendar(spark):
    dim = dim_time(spark)
    assert dim.count() == 4018
    by_day = {str(r["full_date"]): r for r in dim.filter(F.col("year_number").isin(2021, 2023)).collect()}
    first = by_day["2021-01-01"]
    assert (first["week_of_year"], first["day_of_week"], first["is_weekend"]) == (53, 5, False)
    assert first["day_name"] == "Friday   " and first["month_name"] == "January  "
    assert by_day["2023-01-01"]["day_of_week"] == 0 and by_day["2023-01-01"]["is_weekend"]
    assert by_day["2023-02-20"]["holiday_name"] == "Presidents' Day"
    assert sum(r["is_holiday"] for r in by_day.values()) == 10
    assert dim.agg(F.min("time_key"), F.max("time_key")).first()[:] == (1, 4018)
    assert dim_time(spark, unknown=True).filter("time_key = -1").count() == 1


TASK = "id int, status string, created_at timestamp_ntz, due_date timestamp_ntz, status_changed_at timestamp_ntz, " \
       "completed_at timestamp_ntz, estimated_hours decimal(10,2), actual_hours decimal(10,2)"


def test_measures_on_edge_rows(spark):
    day = dt.datetime
    rows = [
        (1, None, day(2024, 1, 1, 10), day(2023, 12, 1), None, None, Decimal("8.00"), Decimal("2.00")),
        (2, "todo", day(2024, 1, 1), day(2024, 1, 10), None, None, Decimal("0.00"), Decimal("2.00")),
        (3, "todo", day(2024, 1, 1), day(2024, 1, 8, 15), None, None, Decimal("3.00"), Decimal("1.00")),
        (4, "completed", day(2024, 1, 1), day(2024, 1, 2), None, day(2024, 1, 5), Decimal("3.00"), Decimal("1.00")),
        (5, "in_progress", day(2024, 1, 1), None, day(2024, 1, 7, 11), None, Decimal("1.00"), Decimal("9.00")),
        (6, "cancelled", day(2024, 1, 1), day(2024, 1, 2), None, None, None, None),
        (7, "in_review", day(2024, 1, 11), None, day(2024, 1, 9), None, Decimal("32.00"), Decimal("1.00")),
    ]
    got = {r["id"]: r for r in with_measures(spark.createDataFrame(rows, TASK), "2024-01-10").collect()}
    # NULL status: the test is NULL and falls through.
    assert (got[1]["is_overdue"], got[1]["days_overdue"], got[1]["days_open"]) == (False, 0, 8)
    assert got[1]["completion_ratio"] == Decimal("25.00")
    # Due today is not overdue; estimate 0 gives ratio 0.
    assert (got[2]["is_overdue"], got[2]["completion_ratio"]) == (False, Decimal("0.00"))
    # Less than two whole days late.
    assert (got[3]["is_overdue"], got[3]["days_overdue"], got[3]["completion_ratio"]) == (True, 1, Decimal("33.33"))
    assert (got[4]["is_overdue"], got[4]["days_completed"], got[4]["completion_ratio"]) == (False, 5, Decimal("100.00"))
    assert (got[5]["days_in_progress"], got[5]["completion_ratio"], got[5]["is_overdue"]) == (2, Decimal("99.90"), False)
    assert (got[6]["is_overdue"], got[6]["completion_ratio"]) == (False, Decimal("0.00"))
    assert (got[7]["days_in_review"], got[7]["days_open"], got[7]["completion_ratio"]) == (1, -1, Decimal("3.13"))


def test_encryption_round_trip_and_missing_key(spark):
    key = bytes(range(32))
    keys = spark.createDataFrame([("user_email_key", bytearray(key))], "key_name string, key_value binary")
    assert crypto.key_value(keys, "user_email_key") == key
    try:
        crypto.key_value(keys, "other")
    except crypto.KeyNotFound:
        pass
    else:
        raise AssertionError("a missing key must raise")
    df = spark.createDataFrame([("a@x",), (None,)], "email string")
    stored = crypto.encrypt_cols(df, ["email"], key)
    assert stored.columns == ["email_encrypted"]
    assert sorted(map(str, crypto.decrypt_cols(stored, ["email"], key).collect())) == sorted(map(str, df.collect()))


def test_hash_only_on_change(spark):
    rows = spark.createDataFrame([("new", None), ("same", "same"), (None, "x")], "n string, o string")
    got = [r[0] for r in rows.select(crypto.hash_on_change(F.col("n"), F.col("o"), F.lit("s"))).collect()]
    assert got[0].startswith("s$") and got[1:] == ["same", None]


def test_keys_are_dense_with_a_third_of_rows_on_one_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = assign_keys(rows, "key", ["k"], start=11)
    keys = sorted(r["key"] for r in got.collect())
    assert keys == list(range(11, 3011))
    # The order of the keys follows the order column.
    pairs = [(r["key"], r["k"]) for r in got.orderBy("key").collect()]
    assert [k for _, k in pairs] == sorted(k for _, k in pairs)


def test_fill_keys_continue_from_the_largest(spark):
    df = spark.createDataFrame([(5, "a"), (9, "b"), (None, "d"), (None, "c")], "key int, name string")
    got = {r["name"]: r["key"] for r in fill_keys(df, "key", ["name"]).collect()}
    assert got == {"a": 5, "b": 9, "c": 10, "d": 11}
