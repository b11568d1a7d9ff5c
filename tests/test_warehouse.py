"""Dimension and fact loads: properties and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from workmill.functions import keys
from workmill.operators import facts, lookup, scd2
from workmill.operators.lookup import lookup_as_of, lookup_as_of_merge
from workmill.operators.merge import merge_update
from workmill.plans import reports
from workmill.plans.registry import AS_OF, DONE
from workmill.sources.projection import Inputs
from workmill.session import cut
from workmill.sources.tables import touch

from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"
USER = "user_id string, email string, first_name string, last_name string, role string, status string, department string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def people(spark, *rows):
    return spark.createDataFrame([(*r, *["x"] * (7 - len(r))) for r in rows], USER)


def test_scd2_unchanged_source_is_a_no_op(spark):
    src = people(spark, ("a", "a@x"), ("b", "b@x"))
    dim = scd2.first_version(src, None, scd2.USERS, "2024-01-01", "B1")
    again = scd2.scd2_merge(dim, src, scd2.USERS, "2024-02-01", "B2")
    assert rows_of(again) == rows_of(dim)


def test_scd2_change_delete_return(spark):
    dim = scd2.first_version(people(spark, ("a", "a@x"), ("b", "b@x"), ("c", "c@x")), None, scd2.USERS, "2024-01-01")
    # a changes a tracked column, b goes, c changes payload only, d is new
    second = people(spark, ("a", "new@x"), ("d", "d@x")).unionByName(
        spark.createDataFrame([("c", "c@x", "x", "x", "x", "x", "moved")], USER)
    )
    dim2 = scd2.scd2_merge(dim, second, scd2.USERS, "2024-02-01 00:00:00", "B2")
    got = {(r["user_id"], r["version_number"]): r for r in dim2.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1)}
    assert got["a", 1]["expiry_date"] == dt.datetime(2024, 1, 31, 23, 59, 59) and not got["a", 1]["is_current"]
    assert got["a", 2]["is_current"] and got["a", 2]["email"] == "new@x" and got["a", 2]["expiry_date"] is None
    assert not got["b", 1]["is_current"]
    assert got["c", 1]["department"] == "x" and got["c", 1]["is_current"]
    # b comes back: left out by default, version 2 when reopening
    third = second.unionByName(people(spark, ("b", "b@x")))
    same = scd2.scd2_merge(dim2, third, scd2.USERS, "2024-03-01")
    assert same.filter("user_id = 'b'").count() == 1
    opened = scd2.scd2_merge(dim2, third, scd2.USERS, "2024-03-01", reopen=True)
    b = opened.filter("user_id = 'b' AND is_current").collect()
    assert [r["version_number"] for r in b] == [2]
    assert scd2.scd2_problems(opened, "user_id").count() == 0


def test_null_safe_tracking(spark):
    src = spark.createDataFrame([("a", "e", None, "l", "r", "s", "d")], USER)
    dim = scd2.first_version(src, None, scd2.USERS, "2024-01-01")
    counts = {r["kind"]: r["row_count"] for r in scd2.scd2_counts(dim, src, scd2.USERS).collect()}
    assert counts == {"unchanged": 1}
    named = src.withColumn("first_name", F.lit("n"))
    assert [r["kind"] for r in scd2.scd2_counts(dim, named, scd2.USERS).collect()] == ["changed"]


def test_as_of_lookup_has_no_one_second_hole(spark):
    dim = scd2.first_version(people(spark, ("a", "old@x")), None, scd2.USERS, "2024-01-01")
    dim = scd2.scd2_merge(dim, people(spark, ("a", "new@x")), scd2.USERS, "2024-02-01")
    ts = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-31 23:59:59.5", "2024-02-01 00:00:00"]
    events = spark.createDataFrame([("a", dt.datetime.fromisoformat(t)) for t in ts], "user string, ts timestamp_ntz")
    got = lookup.lookup_as_of(events, dim, "user", "ts", "user_id", {"email": "email"})
    assert [r["email"] for r in got.orderBy("ts").collect()] == [None, "old@x", "old@x", "new@x"]


def test_second_fact_load_changes_nothing(spark):
    x = Inputs(spark, SF)
    first = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE).withColumn("task_key", F.col("task_id") + 1)
    again = facts.load_fact_tasks(first, x["f_tasks"], x.dims, AS_OF, "B2", **DONE)
    assert {r["kind"]: r["row_count"] for r in again.counts().collect()} == {"unchanged": first.count()}
    assert again.merged().filter("etl_batch_id = 'B2'").count() == 0


def test_a_stale_day_count_is_refreshed_only_when_tracked(spark):
    x = Inputs(spark, SF)
    stored = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE).withColumn("task_key", F.col("task_id"))
    later = "2000-01-02 10:00:00"
    default = facts.load_fact_tasks(stored, x["f_tasks"], x.dims, later, **DONE)
    assert [r["kind"] for r in default.counts().collect()] == ["unchanged"]
    more = facts.load_fact_tasks(stored, x["f_tasks"], x.dims, later, tracked=(*facts.TRACKED, "days_open"), **DONE)
    assert [r["kind"] for r in more.counts().collect()] == ["changed"]


def test_lookup_spreads_null_and_hot_keys(spark):
    tasks = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 50).alias("user")
    )
    dim = spark.range(40).select(F.col("id").alias("uid"), (F.col("id") * 10).cast("int").alias("ukey"))
    plain = tasks.join(dim, tasks["user"] == dim["uid"], "left").select("id", "user", F.col("ukey").alias("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for spread in (1, 4):
            got = lookup.lookup(tasks, dim, "user", "uid", {"k": "ukey"}, spread=spread)
            assert rows_of(got) == rows_of(plain)
            keys = got._jdf.queryExecution().sparkPlan().toString()
            # Key and salt are both join keys, so a NULL or hot key is spread.
            assert "__salt" in keys.split("SortMergeJoin")[1].split("]")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_workload_equals_the_literal_product(spark):
    x = Inputs(spark, SF)
    users, tasks = x["f_users"], x["f_tasks"].filter("assigned_to % 3 <> 0")
    logs = x["f_time_logs"].filter("user_id % 4 <> 0")
    from workmill.functions.moments import minutes_between

    t, lg = tasks.alias("t"), logs.alias("l")
    joined = users.alias("u").join(t, F.col("u.user_id") == F.col("t.assigned_to"), "left").join(
        lg, F.col("u.user_id") == F.col("l.user_id"), "left"
    )
    minutes = minutes_between(F.col("l.start_time"), F.col("l.end_time"))
    literal = joined.groupBy("u.user_id").agg(
        F.count_distinct("t.task_id").alias("total_tasks"),
        F.sum(F.coalesce("t.estimated_hours", F.lit(0))).cast("decimal(24,2)").alias("e"),
        (F.sum(F.coalesce(minutes, F.lit(0))).cast("decimal(20,0)") / 60).cast("decimal(20,4)").alias("h"),
    )
    linear = reports.user_workload(users, tasks, logs, AS_OF).select(
        "user_id", "total_tasks", F.col("total_estimated_hours").alias("e"), F.col("total_logged_hours").alias("h")
    )
    assert rows_of(literal) == rows_of(linear)
    both = [reports.user_workload(users, tasks, logs, AS_OF, unique_tasks=u) for u in (False, True)]
    assert rows_of(both[0]) == rows_of(both[1])


def test_merge_update_keeps_old_where_update_is_null(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, n int, msg string")
    u = spark.createDataFrame([(1, None, None)], "id int, n int, msg string")
    got = merge_update(t, u, "id", ["n", "msg"], keep_old_when_null=["n"], mark="hit")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, None, True), (2, 20, "b", False)]


def test_touch(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, updated_at timestamp_ntz")
    got = touch(df, F.col("id") == 1, AS_OF).orderBy("id").collect()
    assert str(got[0]["updated_at"]) == AS_OF and got[1]["updated_at"] is None


def test_people_keys_do_not_depend_on_the_join_chosen(spark):
    x = Inputs(spark, SF)
    small = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE)
    want = rows_of(small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE)
        assert rows_of(large) == want
        text = large._jdf.queryExecution().optimizedPlan().toString()
        assert "<=> __task_id" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_settled_load_counts_and_merges_alike(spark):
    x = Inputs(spark, SF)
    stored = facts.resolve_tasks(x["f_old_tasks"], x.dims, AS_OF, "B0", **DONE).withColumn("task_key", F.col("task_id"))
    load = facts.load_fact_tasks(stored, x["f_src_tasks"], x.dims, AS_OF, "B1", **DONE)
    rest, kinds = load.settled()
    assert kinds == {r["kind"]: r["row_count"] for r in load.counts().collect()}
    assert rest.classified.count() == kinds["new"] + kinds["changed"]
    assert rows_of(rest.merged()) == rows_of(load.merged())


def test_facts_can_take_the_version_valid_at_creation(spark):
    x = Inputs(spark, SF)

    def versioned(name):
        always = {"effective_date": F.lit("1990-01-01"), "expiry_date": F.lit(None)}
        cols = {n: c.cast("timestamp_ntz") for n, c in always.items()}
        return x[name].withColumns({**cols, "version_number": F.lit(1)})

    dims = facts.Dims(
        x["f_dim_users"], versioned("f_cur_projects"), versioned("f_cur_status"), versioned("f_cur_priority"), x.dims.time
    )
    got = facts.resolve_tasks(x["f_tasks"], dims, AS_OF, valid_at="created_at", **DONE)
    then = lookup.lookup_as_of(x["f_tasks"], x["f_dim_users"], "assigned_to", "created_at", "user_id", {"k": "user_key"})
    assert rows_of(got.select("task_id", F.col("assigned_to_key").alias("k"))) == rows_of(then.select("task_id", "k"))
    # The other keys do not depend on it here.
    now = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, **DONE)
    same = ["task_id", "project_key", "status_key", "priority_key", "due_date_key"]
    assert rows_of(got.select(*same)) == rows_of(now.select(*same))


def test_people_keys_where_task_ids_repeat_or_are_missing(spark):
    x = Inputs(spark, SF)
    one = x["f_tasks"]
    swapped = one.withColumns({"assigned_to": F.col("reporter_id"), "reporter_id": F.col("assigned_to")})
    tasks = one.unionByName(swapped).unionByName(one.withColumn("task_id", F.lit(None).cast(one.schema["task_id"].dataType)))

    def rows():
        return sorted(map(repr, facts.resolve_tasks(tasks, x.dims, AS_OF, "B1", **DONE).collect()))

    want = rows()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_as_of_by_merge_equals_the_join(spark):
    days = F.make_dt_interval(F.col("n"))
    dim = spark.sql("SELECT k, v AS version_number, k * 100 + v AS sk, timestamp_ntz'2024-01-01' + make_dt_interval(3 * v + k % 3) AS effective_date "
                    "FROM (SELECT explode(sequence(0, 40)) AS k) JOIN (SELECT explode(sequence(1, 30)) AS v) WHERE k % 7 <> 6 AND (v <= 2 OR k % 2 = 0)")
    dim = dim.withColumn("expiry_date", F.when(F.col("k") % 5 == 0, F.col("effective_date") + F.expr("INTERVAL 1 DAY")))
    # A third of the rows have one key, some have none or no time.
    rows = spark.range(6000).select("id", F.lit(1).alias("tenant"), F.when(F.col("id") % 3 == 0, 4).when(F.col("id") % 11 == 1, None).otherwise(F.col("id") % 43).cast("int").alias("k"), (F.col("id") % 120 - 5).cast("int").alias("n"))
    rows = rows.select("id", "tenant", "k", F.when(F.col("id") % 17 != 3, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + days).alias("t"))
    take = {"sk": "sk", "v": "version_number"}
    joined = lookup_as_of(rows, dim, "k", "t", "k", take)
    merged = lookup_as_of_merge(rows, dim, "k", "t", "k", take)
    assert merged.columns == joined.columns
    assert merged.exceptAll(joined).count() == 0 and merged.count() == 6000 and joined.filter("sk IS NOT NULL").count() > 2000


def test_numbering_without_an_order_does_not_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(keys, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = spark.range(0, 5000, 1, 7).filter("id % 3 <> 0")
    got = sorted(r[0] for r in keys.assign_keys(rows, "key", start=11).select("key").collect())
    assert got == list(range(11, 11 + len(got))) and len(got) == rows.count()
    keys.assign_keys(rows, "key", ["id"])
    assert "Exchange" not in plans[0] and "Exchange" in plans[1]
