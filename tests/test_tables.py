"""Reading, writing and layout, with the plans they should give."""

import datetime as dt

from pyspark.sql import functions as F

from workmill.operators.lookup import lookup
from workmill.plans import reports
from workmill.sources import schemas, tables
from workmill.sources.projection import Inputs
from workmill.streaming.incremental import NewestTable, merge_newest, run_available, upsert_into

from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def plan(df, kind="executedPlan"):
    df.collect()
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_schemas_parse_and_round_trip(spark, tmp_path):
    for name in schemas.TABLES:
        schemas.schema(name)
    assert schemas.with_keys("tasks", "bigint")["assigned_to"].dataType.simpleString() == "bigint"
    tables.append_row(spark, f"{tmp_path}/tags", schemas.schema("tags"), tag_id="a", name="x", type="CUSTOM")
    tables.append_row(spark, f"{tmp_path}/tags", schemas.schema("tags"), tag_id="b", name="y", deleted_at=dt.datetime(2024, 1, 1))
    tags = tables.read(spark, str(tmp_path), "tags")
    assert tags.count() == 2 and tables.live(tags).first()["tag_id"] == "a"


def test_replace_partitions_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.append(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    tables.replace_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "p").collect()) == [(1, "a"), (9, "b")]
    tables.overwrite(spark.createDataFrame([(5, "c")], "v int, p string"), path, ["p"])
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [5]


def test_versions_skip_an_unfinished_write(spark, tmp_path):
    table = tables.Versions(spark, f"{tmp_path}/t")
    assert not table.exists()
    table.write(spark.range(3))
    # A rewrite may read the version it replaces.
    table.write(table.read().union(spark.range(1)))
    assert table.read().count() == 4 and table.read(1).count() == 3
    (tmp_path / "t" / "v=3").mkdir()
    assert table.read().count() == 4
    table.prune(keep=1)
    assert table._complete() == [2]


def test_month_directories_are_pruned(spark, tmp_path):
    logs = tables.month_partition(Inputs(spark, SF)["f_time_logs"], "start_time")
    tables.overwrite(logs, f"{tmp_path}/logs", ["month"])
    stored = spark.read.parquet(f"{tmp_path}/logs")
    some = tables.in_months(stored, "start_time", "1998-03-15", "1998-05-01")
    text = plan(some)
    assert "PartitionFilters: [isnotnull(month" in text and "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time" in text
    want = logs.filter((F.col("start_time") >= "1998-03-15") & (F.col("start_time") < "1998-05-01"))
    assert some.count() == want.count() > 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    x = Inputs(spark, SF)
    tables.save_bucketed(x["f_tasks"], "b_tasks", "task_id", 4)
    tables.save_bucketed(x["f_time_logs"], "b_logs", "task_id", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_logs").join(spark.table("b_tasks").select("task_id", "status"), "task_id")
        assert "Exchange" not in plan(joined)
        # Neither does a lookup on a key that is always there.
        found = lookup(spark.table("b_logs"), spark.table("b_tasks"), "task_id", "task_id", {"task_status": "status"}, nullable=False)
        assert "Exchange" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE b_tasks")
        spark.sql("DROP TABLE b_logs")


def test_filters_and_columns_reach_the_scan(spark):
    x = Inputs(spark, SF)
    text = plan(reports.recent_comments(x["f_comments"], 7).select("comment_id"))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in scan
    text = plan(reports.unread_notifications(x["f_notifications"]).select("notification_id"))
    assert "EqualTo(event_type,view)" in text


def test_metrics_join_after_aggregation(spark):
    x = Inputs(spark, SF)
    text = plan(reports.task_metrics(x["f_tasks"], x["f_projects"], "2000-01-01"), "optimizedPlan")
    # The outer join with projects sits above the aggregate.
    assert text.index("Join LeftOuter") < text.index("Aggregate")


def test_calendars(spark):
    months = [r[:] for r in tables.month_calendar(spark, "2023-11-30").orderBy("starts").collect()]
    assert len(months) == 12
    assert months[0] == ("time_logs_y2023m11", dt.date(2023, 11, 1), dt.date(2023, 12, 1))
    assert months[-1][0] == "time_logs_y2024m10"
    other = tables.month_calendar(spark, "2023-11-30", table="audit_logs", version=2).orderBy("starts").first()
    assert other["partition_name"] == "audit_logs_2023_11"
    quarters = [r[:] for r in tables.quarter_calendar(spark, "2025-05-05").orderBy("starts").collect()]
    assert len(quarters) == 8
    assert quarters[3] == ("tasks_2025_q4", dt.date(2025, 10, 1), dt.date(2026, 1, 1))


def test_stream_keeps_the_newest_row_and_survives_replay(spark, tmp_path):
    schema = "k string, n int, ts timestamp_ntz"
    day = dt.datetime
    drop = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, day(2024, 1, 1)), ("b", 1, day(2024, 1, 5))], schema).write.parquet(drop)
    table = NewestTable(spark, str(tmp_path / "t"), "k", ["ts"])
    handle = upsert_into(table)
    run = lambda: run_available(spark, drop, schema, str(tmp_path / "state"), handle)
    run()
    # A late older row for b and a newer one for a.
    spark.createDataFrame([("b", 0, day(2023, 1, 1)), ("a", 2, day(2024, 2, 1)), ("c", 1, day(2024, 1, 1))], schema).write.mode("append").parquet(drop)
    run()
    want = [("a", 2), ("b", 1), ("c", 1)]
    assert sorted((r["k"], r["n"]) for r in table.read().collect()) == want
    version = table.parts._numbers()
    run()
    assert table.parts._numbers() == version
    again = merge_newest(table.read(), spark.read.schema(schema).parquet(drop), "k", ["ts"])
    assert sorted((r["k"], r["n"]) for r in again.collect()) == want
