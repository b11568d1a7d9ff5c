"""Reports narrowed to one user, project, tenant, ... equal the filtered whole."""

from pyspark.sql import functions as F

from workmill.plans import reports
from workmill.plans.registry import AS_OF
from workmill.sources.projection import Inputs

from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_one_of_many(spark):
    x = Inputs(spark, SF)
    tasks = x["f_tasks"]
    user = tasks.filter("assigned_to IS NOT NULL AND status <> 'done'").orderBy("due_date").first()["assigned_to"]
    pairs = [
        (reports.overdue_tasks(tasks, AS_OF, user), reports.overdue_tasks(tasks, AS_OF).filter(F.col("assigned_to") == user)),
        (reports.tasks_of_user(tasks, user, "todo"), tasks.filter((F.col("assigned_to") == user) & (F.col("status") == "todo"))),
        (reports.project_tasks(tasks, 3), tasks.filter("project_id = 3")),
        (reports.child_tasks(tasks, 7), tasks.filter("parent_task_id = 7")),
        (reports.unread_notifications(x["f_notifications"], 5), x["f_notifications"].filter("user_id = 5 AND NOT is_read")),
        (reports.audit_trail(x["f_audit"], "task", 14), x["f_audit"].filter("entity_type = 'task' AND entity_id = 14")),
        (reports.recent_comments(x["f_comments"], 7), x["f_comments"].filter("task_id = 7 AND deleted_at IS NULL")),
    ]
    for ours, want in pairs:
        assert rows_of(ours) == rows_of(want)
    assert reports.overdue_tasks(tasks, AS_OF, user).count() > 0


def test_hours_of_one_tenant(spark):
    x = Inputs(spark, SF)
    logs, tasks, projects = x["f_time_logs"], x["f_tasks"], x["f_projects"]
    one = reports.hours_by_project(logs, tasks, projects, 2)
    want = reports.hours_by_project(logs, tasks.filter("organization_id = 2"), projects)
    assert rows_of(one) == rows_of(want) and one.count() > 0


def test_orders_put_missing_values_where_the_source_does(spark):
    df = spark.createDataFrame([(1, None, "todo", None), (1, 2, "todo", None)], "assigned_to int, task_id int, status string, due_date timestamp_ntz")
    assert [r["task_id"] for r in reports.tasks_of_user(df).collect()] == [2, None]
    users = spark.createDataFrame([(1, "active", "2024-01-01"), (2, "active", None)], "user_id int, status string, last_login_at string")
    assert [r["user_id"] for r in reports.recent_users(users).collect()] == [2, 1]
    batches = spark.createDataFrame([], "batch_id string, batch_start_time timestamp_ntz, batch_end_time timestamp_ntz, status string")
    assert reports.latest_batch(batches).count() == 0


def test_running_batch_has_no_duration(spark):
    x = Inputs(spark, SF)
    running = x["f_batches"].filter("status = 'RUNNING'")
    assert reports.latest_batch(running).first()["duration_seconds"] is None
    assert reports.batch_status(running, "2024-01-31", 2400).filter("duration_minutes IS NOT NULL").count() == 0
