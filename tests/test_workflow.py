"""The full load on a small warehouse, its logs, and its failures."""

import datetime as dt
import os
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from workmill.functions.keys import without_keys
from workmill.operators import oplog
from workmill.operators.governance import TenantScope
from workmill.plans import reports
from workmill.plans.workflow import Config, WorkflowError, load_tasks, load_time_logs, run_workflow
from workmill.session import shared_folder
from workmill.streaming.incremental import Landing, scheduled_run

DAY = dt.datetime


def sources(spark):
    users = spark.createDataFrame(
        [(u, f"{u}@x", "F", u, "member", "active") for u in ("u1", "u2", "u3")],
        "user_id string, email string, first_name string, last_name string, role string, status string",
    )
    projects = spark.createDataFrame(
        [("p1", "One", "active"), ("p2", "Two", "planning")], "project_id string, project_name string, status string"
    )
    status = spark.createDataFrame(
        [(s, s.title(), "x", True) for s in ("backlog", "todo", "in_progress", "in_review", "done")],
        "status_id string, status_name string, status_category string, is_active boolean",
    )
    priority = spark.createDataFrame(
        [("high", "High", 2, True), ("low", "Low", 4, True)],
        "priority_id string, priority_name string, priority_level int, is_active boolean",
    )
    tasks = spark.createDataFrame(
        [
            (f"t{i}", "p1" if i % 2 else "p2", f"Task {i}", "todo", "low", DAY(2024, 1 + i % 3, 3), DAY(2024, 3, 1), None, None,
             Decimal("8.00"), Decimal("2.00"), f"u{1 + i % 3}", "u1", f"SK{i}", False, Decimal("3.00"), None)
            for i in range(12)
        ],
        "task_id string, project_id string, title string, status string, priority string, created_at timestamp_ntz, "
        "due_date timestamp_ntz, status_changed_at timestamp_ntz, completed_at timestamp_ntz, estimated_hours decimal(10,2), "
        "actual_hours decimal(10,2), assigned_to string, reporter_id string, task_sk string, is_blocked boolean, "
        "story_points decimal(5,2), parent_task_id string",
    )
    logs = spark.createDataFrame(
        [(f"l{i}", f"t{i % 12}", f"u{1 + i % 3}", DAY(2024, 3, 9, 8), DAY(2024, 3, 9, 9, 30), i % 2 == 0, Decimal("50.00")) for i in range(24)],
        "log_id string, task_id string, user_id string, start_time timestamp_ntz, end_time timestamp_ntz, billable boolean, hourly_rate decimal(10,2)",
    )
    return {"users": users, "projects": projects, "task_status": status, "priority": priority, "tasks": tasks, "time_logs": logs}


def config(spark, root, tables, as_of):
    return Config(spark, str(root), tables.__getitem__, as_of, ("2024-01-01", "2024-12-31"), ("done",), ("done", "cancelled"))


def test_two_runs(spark, tmp_path):
    tables = sources(spark)
    cfg = config(spark, tmp_path, tables, "2024-03-09 12:00:00")
    first = run_workflow(cfg)
    fact = cfg.fact("fact_tasks").read()
    assert sorted(r[0] for r in fact.select("task_key").collect()) == list(range(1, 13))
    assert fact.filter("is_overdue").count() == 12
    logs = cfg.fact("fact_time_logs").read()
    assert logs.agg(F.sum("billing_amount")).first()[0] == Decimal("900.00")
    work = spark.read.parquet(f"{tmp_path}/agg_user_workload")
    assert work.agg(F.sum("total_hours_logged")).first()[0] == Decimal("36.00")
    daily = spark.read.parquet(f"{tmp_path}/agg_daily_task_metrics")
    assert daily.agg(F.sum("task_count"), F.sum("open_tasks")).first()[:] == (12, 12)
    assert cfg.table("dim_time").read().count() == 366

    # One task done, one new, one user renamed, one gone; the rest unchanged.
    done = F.col("task_id") == "t4"
    t2 = tables["tasks"].withColumns(
        {
            "status": F.when(done, "done").otherwise(F.col("status")),
            "completed_at": F.when(done, F.lit(DAY(2024, 3, 10)).cast("timestamp_ntz")).otherwise(F.col("completed_at")),
        }
    )
    extra = t2.filter("task_id = 't0'").withColumns({"task_id": F.lit("t99"), "title": F.lit("new")})
    u2 = tables["users"].filter("user_id <> 'u3'").withColumn(
        "last_name", F.when(F.col("user_id") == "u2", "Renamed").otherwise(F.col("last_name"))
    )
    tables = {**tables, "tasks": t2.unionByName(extra), "users": u2}
    cfg = config(spark, tmp_path, tables, "2024-03-10 12:00:00")
    second = run_workflow(cfg)
    fact = cfg.fact("fact_tasks").read()
    assert fact.count() == 13
    assert fact.filter("task_id = 't99'").first()["task_key"] == 13
    four = fact.filter("task_id = 't4'").first()
    assert four["completion_ratio"] == Decimal("100.00") and four["completed_date_key"] == 70
    assert fact.filter("task_id = 't5'").first()["etl_batch_id"] != four["etl_batch_id"]
    users = cfg.table("dim_users").read()
    assert users.count() == 4 and users.filter("is_current").count() == 2
    assert sorted(r[0] for r in users.select("user_key").collect()) == [1, 2, 3, 4]

    batches = {r["batch_id"]: r for r in cfg.log.batches().collect()}
    assert batches[first]["status"] == batches[second]["status"] == "COMPLETED"
    # The master carries the sums of its steps.
    steps = [b for b in batches.values() if b["parent_batch_id"] == second]
    assert batches[second]["records_inserted"] == sum(b["records_inserted"] for b in steps)
    tasks_step = next(b for b in steps if b["source_system"] == "FACT_TASKS_LOAD")
    assert (tasks_step["records_inserted"], tasks_step["records_updated"]) == (1, 1)
    audit = cfg.log.audits().filter(F.col("batch_id") == tasks_step["batch_id"]).first()
    assert audit["records_affected"] == 2 and audit["execution_time_seconds"] > 0

    # A third run on the same sources changes nothing.
    run_workflow(cfg)
    assert cfg.fact("fact_tasks").read().count() == 13
    assert cfg.table("dim_users").read().count() == 4


def test_failure_leaves_its_log(spark, tmp_path):
    tables = sources(spark)
    tables["tasks"] = tables["tasks"].withColumn("actual_hours", F.raise_error(F.lit("broken source")).cast("decimal(10,2)"))
    cfg = config(spark, tmp_path, tables, "2024-03-09 12:00:00")
    with pytest.raises(WorkflowError, match="broken source"):
        run_workflow(cfg)
    failed = cfg.log.batches().filter("status = 'FAILED'")
    assert sorted(r["source_system"] for r in failed.collect()) == ["FACT_TASKS_LOAD", "FULL_ETL_WORKFLOW"]
    assert sorted(r["error_severity"] for r in cfg.log.errors().collect()) == ["CRITICAL", "ERROR"]
    assert cfg.log.audits().filter("status = 'FAILED'").count() == 1
    # Later steps did not run; earlier ones are complete.
    done = [r["source_system"] for r in cfg.log.batches().filter("status = 'COMPLETED'").collect()]
    assert "DIM_USERS_LOAD" in done and "FACT_TIME_LOGS_LOAD" not in done
    with pytest.warns(UserWarning, match="broken source"):
        run_workflow(cfg, raise_on_error=False)


def test_log_api(spark, tmp_path):
    log = oplog.LoadLog(spark, str(tmp_path))
    with pytest.raises(oplog.UnknownBatch):
        log.end("nope", "COMPLETED")
    batch = log.start("TEST")
    log.end(batch, "COMPLETED", processed=5, inserted=3)
    log.end(batch, "FAILED", "late problem", updated=1)
    row = log.batches().first()
    # NULL counters keep the earlier value; status and message are the last.
    assert (row["records_processed"], row["records_inserted"], row["records_updated"]) == (5, 3, 1)
    assert (row["status"], row["error_message"]) == ("FAILED", "late problem")
    log.end(batch, "COMPLETED")
    assert log.batches().first()["error_message"] is None
    with pytest.raises(oplog.UnknownBatch):
        log.end("other", "COMPLETED")
    # Another session finds the batch in the log itself.
    oplog.LoadLog(spark, str(tmp_path)).end(batch, "COMPLETED")
    log.audit(batch, "t", "LOAD", "COMPLETED", 1, DAY(2024, 1, 1), None)
    log.audit(batch, "t", "LOAD", "COMPLETED", 1, DAY(2024, 1, 1), DAY(2024, 1, 1, 0, 0, 1, 5000))
    took = sorted((r["execution_time_seconds"] for r in log.audits().collect()), key=lambda v: (v is not None, v))
    assert took == [None, Decimal("1.01")]
    assert reports.latest_batch(log.batches()).first()["batch_id"] == batch
    assert reports.batch_status(log.batches(), oplog.now() + dt.timedelta(hours=1), 24).count() == 1
    assert reports.batch_status(log.batches(), oplog.now() + dt.timedelta(hours=30), 24).count() == 0


def test_scheduled_run_takes_in_landed_files(spark, tmp_path):
    tables = sources(spark)
    cfg = config(spark, tmp_path / "wh", tables, "2024-03-09 12:00:00")
    users = tables["users"].withColumn("updated_at", F.lit(DAY(2024, 3, 1)).cast("timestamp_ntz"))
    drop = str(tmp_path / "in")
    users.write.parquet(drop)
    land = Landing("users", drop, ", ".join(f"{n} {t}" for n, t in users.dtypes), "user_id", ("updated_at",))
    scheduled_run(cfg, [land])
    assert cfg.table("dim_users").read().count() == 3
    renamed = users.filter("user_id = 'u1'").withColumns(
        {"last_name": F.lit("New"), "updated_at": F.lit(DAY(2024, 3, 9)).cast("timestamp_ntz")}
    )
    renamed.write.mode("append").parquet(drop)
    cfg.as_of = "2024-03-10 12:00:00"
    scheduled_run(cfg, [land])
    dim = cfg.table("dim_users").read()
    assert dim.count() == 4 and dim.filter("user_id = 'u1' AND is_current").first()["version_number"] == 2


def test_rows_without_a_creation_time_survive_later_loads(spark, tmp_path):
    tables = sources(spark)
    dated = tables["tasks"]
    undated = F.col("task_id").isin("t0", "t1", "t2")
    tables["tasks"] = dated.withColumn("created_at", F.when(~undated, F.col("created_at")))
    cfg = config(spark, tmp_path, tables, "2024-03-09 12:00:00")
    run_workflow(cfg)
    before = {r["task_id"]: r["task_key"] for r in cfg.fact("fact_tasks").read().collect()}

    tables["tasks"] = tables["tasks"].withColumn("title", F.when(F.col("task_id") == "t0", "renamed").otherwise(F.col("title")))
    cfg.as_of = "2024-03-10 12:00:00"
    load_tasks(cfg)
    rows = cfg.fact("fact_tasks").read().collect()
    assert len(rows) == 12 and {r["task_id"]: r["task_key"] for r in rows} == before
    assert [r["title"] for r in rows if r["task_id"] == "t0"] == ["renamed"]

    # All get a date, and the partition without one is emptied.
    tables["tasks"] = dated.withColumn("title", F.when(undated, "dated").otherwise(F.col("title")))
    cfg.as_of = "2024-03-11 12:00:00"
    load_tasks(cfg)
    rows = cfg.fact("fact_tasks").read().collect()
    assert len(rows) == 12 and {r["task_id"]: r["task_key"] for r in rows} == before
    assert all(r["created_month"] is not None for r in rows)


def test_log_counts_beyond_32_bits(spark, tmp_path):
    log = oplog.LoadLog(spark, str(tmp_path))
    batch = log.start("BIG")
    log.audit(batch, "t", "LOAD", "COMPLETED", 3_000_000_000, oplog.now(), oplog.now())
    log.end(batch, "COMPLETED", processed=3_000_000_000, inserted=3_000_000_000, updated=0, failed=0)
    assert [r["records_affected"] for r in log.audits().collect()] == [3_000_000_000]


def test_failing_landing_is_logged(spark, tmp_path):
    tables = sources(spark)
    cfg = config(spark, tmp_path / "wh", tables, "2024-03-09 12:00:00")
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.parquet").write_bytes(b"not a parquet file")
    land = Landing("users", str(tmp_path / "landed"), "user_id string, version int", "user_id", ("version",))
    with pytest.warns(UserWarning, match="landing of users failed"):
        batch = scheduled_run(cfg, [land])
    assert [(r["batch_id"], r["error_severity"]) for r in cfg.log.errors().collect()] == [(batch, "CRITICAL")]


def test_history_bridge_and_tenants_are_loaded_as_steps(spark, tmp_path):
    tables = sources(spark)
    tables["tasks"] = tables["tasks"].withColumn("organization_id", F.when(F.col("project_id") == "p1", "o1").otherwise("o2"))
    tables["time_logs"] = tables["time_logs"].withColumn("organization_id", F.lit("o1"))
    pairs = [(f"t{i}", f"u{1 + (i + j) % 3}", DAY(2024, 2, 1)) for i in range(12) for j in range(2)]
    tables["task_assignments"] = spark.createDataFrame(pairs, "task_id string, user_id string, assigned_at timestamp_ntz")
    cfg = config(spark, tmp_path, tables, "2024-03-09 12:00:00")
    cfg.assignments = "task_assignments"
    run_workflow(cfg)
    history = cfg.fact("fact_task_history")
    first = history.read()
    assert first.filter("change_type = 'INSERT' AND field_changed = 'title'").count() == 12
    keys = sorted(r[0] for r in first.select("history_key").collect())
    assert keys == list(range(1, len(keys) + 1))
    bridge = cfg.fact("bridge_task_assignees")
    assert bridge.read().count() == 24 and bridge.read().filter("is_primary").count() == 12

    change = F.col("task_id") == "t4"
    tables["tasks"] = tables["tasks"].withColumns({"title": F.when(change, "renamed").otherwise(F.col("title")), "priority": F.when(change, "high").otherwise(F.col("priority"))})
    gone = (F.col("task_id") == "t3") & (F.col("user_id") == "u1")
    tables["task_assignments"] = tables["task_assignments"].filter(~gone).unionByName(spark.createDataFrame([("t5", "u2", DAY(2024, 3, 9))], "task_id string, user_id string, assigned_at timestamp_ntz"))
    cfg.as_of = "2024-03-10 12:00:00"
    second = run_workflow(cfg)
    new = history.read().filter(F.col("history_key") > len(keys))
    got = {r["field_changed"]: r for r in new.collect()}
    assert set(got) == {"title", "priority_key"} and (got["title"]["old_value"], got["title"]["new_value"]) == ("Task 4", "renamed")
    four = cfg.fact("fact_tasks").read().filter("task_id = 't4'").first()
    assert all((r["change_type"], r["task_key"], r["organization_id"], r["changed_date_key"]) == ("UPDATE", four["task_key"], "o2", 70) for r in got.values())
    batch = cfg.log.batches().filter((F.col("parent_batch_id") == second) & (F.col("source_system") == "BRIDGE_TASK_ASSIGNEES_LOAD")).first()
    pair = {(r["task_key"], r["user_key"]) for r in bridge.read().collect()}
    assert len(pair) == bridge.read().count() == 24 - 1 + (("t5", "u2", DAY(2024, 2, 1)) not in pairs)
    assert batch["records_updated"] >= 1
    assert bridge.read().filter(F.col("etl_batch_id") == batch["batch_id"]).count() <= 2

    # Nothing new: no row is added anywhere.
    versions = [cfg.fact(n).number() for n in ("fact_tasks", "fact_task_history", "bridge_task_assignees")]
    run_workflow(cfg)
    assert [cfg.fact(n).number() for n in ("fact_tasks", "fact_task_history", "bridge_task_assignees")] == versions

    scope = TenantScope("o1")
    for name in ("fact_tasks", "fact_time_logs", "fact_task_history", "bridge_task_assignees"):
        rows = cfg.fact(name).read()
        seen = scope.apply(name, rows)
        assert 0 < seen.count() <= rows.count() and seen.filter("organization_id <> 'o1'").count() == 0, name
    daily = spark.read.parquet(f"{tmp_path}/agg_daily_task_metrics")
    assert scope.apply("agg_daily_task_metrics", daily).agg(F.sum("task_count")).first()[0] == 6 * 2


def test_history_makes_up_for_a_run_that_died(spark, tmp_path, monkeypatch):
    tables = sources(spark)
    cfg = config(spark, tmp_path, tables, "2024-03-09 12:00:00")
    cfg.keep_versions = 1
    run_workflow(cfg)
    n = cfg.fact("fact_task_history").read().count()
    for day, title in ((10, "a"), (11, "b")):
        tables["tasks"] = tables["tasks"].withColumn("title", F.when(F.col("task_id") == "t4", title).otherwise(F.col("title")))
        cfg.as_of = f"2024-03-{day} 12:00:00"
        load_tasks(cfg)  # the history step never ran
    run_workflow(cfg)
    new = cfg.fact("fact_task_history").read().filter(F.col("history_key") > n).collect()
    assert [(r["field_changed"], r["old_value"], r["new_value"]) for r in new] == [("title", "Task 4", "b")]


def _shuffled_wide(spark, call, monkeypatch):
    """Columns of each set of rows that `call` gathers by month."""
    from workmill.plans import workflow

    seen, gather = [], workflow.balanced

    def watched(rows, by):
        seen.append(rows.columns)
        return gather(rows, by)

    monkeypatch.setattr(workflow, "balanced", watched)
    call()
    return seen


def test_rows_that_stay_are_not_gathered_again(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    tables = sources(spark)
    run_workflow(config(spark, tmp_path, tables, "2024-03-09 12:00:00"))
    cfg = config(spark, tmp_path, tables, "2024-03-10 12:00:00")
    before = {r["time_log_id"]: r.asDict() for r in cfg.fact("fact_time_logs").read().collect()}
    logs = tables["time_logs"]
    extra = logs.filter("log_id = 'l1'").withColumn("log_id", F.lit("l99"))
    tables["time_logs"] = logs.withColumn("hourly_rate", F.when(F.col("log_id") == "l3", F.lit(Decimal("70.00"))).otherwise(F.col("hourly_rate"))).unionByName(extra)
    joined, real = [], DataFrame.join

    def join(self, other, on=None, how=None):
        if how == "left_anti":
            joined.append(on)
        return real(self, other, on, how)

    monkeypatch.setattr(DataFrame, "join", join)
    gathered = _shuffled_wide(spark, lambda: load_time_logs(cfg), monkeypatch)
    # Only changed and new rows, without what follows from their other columns.
    assert joined == [] and len(gathered) == 1 and "billing_amount" not in gathered[0]
    after = {r["time_log_id"]: r.asDict() for r in cfg.fact("fact_time_logs").read().collect()}
    assert cfg.fact("fact_time_logs").read().count() == 25
    assert {k for k in before if before[k] != after[k]} == {"l3"}
    assert (after["l3"]["billing_rate"], after["l3"]["time_log_key"]) == (Decimal("70.00"), before["l3"]["time_log_key"])
    assert after["l99"]["time_log_key"] == 25


def test_marks_take_out_the_same_rows_as_a_join(spark):
    rows = spark.range(1, 100001).selectExpr("id AS k", "id % 7 AS v").unionByName(spark.range(3).selectExpr("CAST(NULL AS BIGINT) AS k", "id AS v"))
    gone = spark.range(1, 100001).selectExpr("id AS k").filter("k % 3 = 0 OR k IN (1, 64, 65, 32768, 32769)")
    gone = gone.unionByName(gone.limit(10))
    want = rows.join(gone, "k", "left_anti").agg(F.count("*"), F.sum("k"), F.sum("v")).first()
    for most in (1 << 30, 10):
        found = without_keys(rows, "k", gone, 100000, most)
        assert found.agg(F.count("*"), F.sum("k"), F.sum("v")).first() == want
    assert without_keys(rows, "k", gone.limit(0), 100000).count() == 100003


def test_every_stored_row_of_a_changed_key_is_replaced(spark, tmp_path):
    tables = sources(spark)
    twice = tables["tasks"].unionByName(tables["tasks"].filter("task_id = 't4'").withColumn("title", F.lit("Other")))
    run_workflow(config(spark, tmp_path, {**tables, "tasks": twice}, "2024-03-09 12:00:00"))
    cfg = config(spark, tmp_path, tables, "2024-03-10 12:00:00")
    # One of the two stored rows equals the one that comes in, the other does not.
    assert (load_tasks(cfg).updated, cfg.fact("fact_tasks").read().filter("task_id = 't4'").count()) == (1, 1)
    assert cfg.fact("fact_tasks").read().count() == 12


def _left(spark):
    """Tables that `cut` has written and nothing deleted."""
    folder = f"{shared_folder(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    return {name for name in os.listdir(folder) if os.path.exists(f"{folder}/{name}/_SUCCESS")} if os.path.isdir(folder) else set()


def _second(spark, root, tables):
    """The stored logs after a load in which each third log has a new rate, one
    came, two have no key and one comes twice; and the counts of that load."""
    cfg = config(spark, root, tables, "2024-03-10 12:00:00")
    load_time_logs(cfg)
    logs = tables["time_logs"]
    third = F.substring("log_id", 2, 9).cast("int") % 3 == 0
    changed = logs.withColumn("hourly_rate", F.when(third, F.lit(Decimal("70.00"))).otherwise(F.col("hourly_rate")))
    nameless = logs.filter("log_id IN ('l1', 'l2')").withColumn("log_id", F.lit(None).cast("string"))
    came = logs.filter("log_id = 'l1'").withColumn("log_id", F.lit("l99"))
    more = changed.unionByName(came).unionByName(nameless).unionByName(logs.filter("log_id = 'l5'"))
    cfg.source = {**tables, "time_logs": more}.__getitem__
    done = load_time_logs(cfg)
    found = cfg.fact("fact_time_logs").read().drop("etl_batch_id").orderBy("time_log_key").collect()
    # New rows are numbered where they are.
    return done, [r["time_log_key"] for r in found], sorted(str({**r.asDict(), "time_log_key": min(r["time_log_key"], done.unchanged + done.updated)}) for r in found)


def test_many_logs_are_compared_in_shares(spark, tmp_path, monkeypatch):
    from workmill.plans import workflow

    tables, seen, real = sources(spark), [], workflow.facts.classify
    cfg = config(spark, tmp_path / "a", tables, "2024-03-09 12:00:00")
    workflow.load_time(cfg)
    for step in workflow._standard(cfg, None)[:5]:
        step()
    for copy in "bc":
        shutil.copytree(tmp_path / "a", tmp_path / copy)
    monkeypatch.setattr(workflow.facts, "classify", lambda *args: seen.append(args[2]) or real(*args))
    monkeypatch.setattr(workflow, "broadcastable", lambda rows: False)
    done, keys, rows = _second(spark, tmp_path / "a", tables)
    assert seen == ["time_log_id"] * workflow.SHARES
    assert (done.processed, done.inserted, done.updated) == (28, 3, 8)
    # With two logs there are shares without any.
    few = _second(spark, tmp_path / "c", tables | {"time_logs": tables["time_logs"].filter("log_id IN ('l1', 'l5')")})[0]
    assert (few.processed, few.inserted, few.updated) == (5, 2, 0)
    monkeypatch.setattr(workflow, "SHARES", 1)
    assert _second(spark, tmp_path / "b", tables) == (done, keys, rows)


def test_runs_leave_no_tables_or_shuffles_of_their_own(spark, tmp_path, monkeypatch):
    from workmill.plans import workflow

    tables, cleared, real = sources(spark), [], workflow.release
    monkeypatch.setattr(workflow, "release", lambda session: cleared.append(session) or real(session))
    assignments = spark.createDataFrame([("t1", "u1", DAY(2024, 3, 1)), ("t2", "u2", DAY(2024, 3, 1))], "task_id string, user_id string, assigned_at timestamp_ntz")
    before = _left(spark)
    for day in ("09", "10"):
        cfg = config(spark, tmp_path, {**tables, "assignments": assignments}, f"2024-03-{day} 12:00:00")
        cfg.assignments = "assignments"
        last = run_workflow(cfg)
        assert _left(spark) == before
        title = F.when(F.col("task_id") == "t4", F.lit("b")).otherwise(F.col("title"))
        role = F.when(F.col("user_id") == "u2", F.lit("admin")).otherwise(F.col("role"))
        tables |= {"tasks": tables["tasks"].withColumn("title", title), "users": tables["users"].withColumn("role", role)}
        assignments = assignments.filter("task_id = 't1'")
    assert len(cleared) > cfg.log.batches().filter(F.col("parent_batch_id").isNotNull()).count()
    assert cfg.fact("fact_tasks").read().filter("title = 'b'").count() == 1 and last
