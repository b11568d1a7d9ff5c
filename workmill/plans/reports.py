"""Reports over the source model. Every function returns a lazy DataFrame.

Where only an access path was given, its key order and predicate are kept and
the output columns and aggregates are ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.functions.moments import at, minutes_between, month_of, on, seconds_between, since
from workmill.functions.scalars import asc, desc, total
from workmill.sources.tables import in_months, live

CLOSED = ("done", "cancelled")


def _midnight(as_of) -> Column:
    return on(as_of).cast("timestamp_ntz")


# -- summary views -------------------------------------------------------------


def task_metrics(tasks: DataFrame, projects: DataFrame, as_of) -> DataFrame:
    """Status counts, overdue count and hours per organization and project.

    Tasks are reduced to one row per (organization, project) before they meet
    the projects, so the join never sees task rows. `project_name` follows from
    the project, so grouping before the join groups the same rows.
    """
    status = F.col("status")
    late = (F.col("due_date") < _midnight(as_of)) & (status != "done")
    counts = tasks.groupBy("organization_id", "project_id").agg(
        *[F.count_if(status == s).alias(f"{s}_count") for s in ("todo", "in_progress", "in_review", "done")],
        F.count_if(late).alias("overdue_count"),
        total(F.col("estimated_hours")).alias("total_estimated_hours"),
        total(F.col("actual_hours")).alias("total_actual_hours"),
    )
    names = projects.select("project_id", F.col("name").alias("project_name"))
    out = counts.join(names, "project_id", "left")
    return out.select(
        "organization_id",
        "project_id",
        "project_name",
        "todo_count",
        "in_progress_count",
        "in_review_count",
        "done_count",
        "overdue_count",
        F.col("total_estimated_hours").cast("decimal(20,2)").alias("total_estimated_hours"),
        F.col("total_actual_hours").cast("decimal(20,2)").alias("total_actual_hours"),
    )


def _user_tasks(tasks: DataFrame, as_of, unique: bool) -> DataFrame:
    """Per assignee: distinct task counts, row count, estimated hours.

    Distinct counting goes through one row per (assignee, task), which spreads
    a busy assignee over all tasks of the shuffle. With ids known unique the
    first step is skipped and counting combines before the shuffle.
    """
    active = F.col("status") != "done"
    late = (F.col("due_date") < _midnight(as_of)) & active
    mine = tasks.filter(F.col("assigned_to").isNotNull())
    if unique:
        per_task = mine.select(
            F.col("assigned_to").alias("__user"),
            F.coalesce(active, F.lit(False)).alias("active"),
            F.coalesce(late, F.lit(False)).alias("late"),
            F.lit(1).alias("copies"),
            F.coalesce("estimated_hours", F.lit(0)).alias("hours"),
        )
    else:
        per_task = mine.groupBy(F.col("assigned_to").alias("__user"), "task_id").agg(
            F.coalesce(F.bool_or(active), F.lit(False)).alias("active"),
            F.coalesce(F.bool_or(late), F.lit(False)).alias("late"),
            F.count(F.lit(1)).alias("copies"),
            total(F.col("estimated_hours")).alias("hours"),
        )
    return per_task.groupBy("__user").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if("active").alias("active_tasks"),
        F.count_if("late").alias("overdue_tasks"),
        F.sum("copies").alias("__tasks"),
        F.sum("hours").alias("__estimated"),
    )


def _user_logs(logs: DataFrame) -> DataFrame:
    minutes = minutes_between(F.col("start_time"), F.col("end_time"))
    return logs.groupBy(F.col("user_id").alias("__user")).agg(
        F.count(F.lit(1)).alias("__logs"), F.sum(F.coalesce(minutes, F.lit(0)).cast("bigint")).alias("__minutes")
    )


def user_workload(
    users: DataFrame, tasks: DataFrame, logs: DataFrame, as_of, exact: bool = False, unique_tasks: bool = False
) -> DataFrame:
    """Task counts and hours per user.

    The view this stands for joins a user's tasks with a user's logs, so every
    task row repeats once per log and every log once per task. That product is
    never built: each side is reduced to one row per user, and a sum over the
    product is the side's own sum times the other side's row count (at least
    one, as the joins are outer). `exact=True` leaves the factors out and gives
    the plain sums.
    """
    t = _user_tasks(tasks, as_of, unique_tasks)
    rows = users.join(t, users["user_id"] == t["__user"], "left").drop("__user")
    lg = _user_logs(logs)
    rows = rows.join(lg, rows["user_id"] == lg["__user"], "left").drop("__user")
    zero = F.lit(0)
    times_logs = F.lit(1) if exact else F.greatest(F.coalesce("__logs", zero), F.lit(1))
    times_tasks = F.lit(1) if exact else F.greatest(F.coalesce("__tasks", zero), F.lit(1))
    estimated = F.coalesce("__estimated", zero).cast("decimal(20,2)") * times_logs.cast("decimal(18,0)")
    # A product of two totals can exceed 64 bits.
    minutes = F.coalesce("__minutes", zero).cast("decimal(19,0)") * times_tasks.cast("decimal(19,0)")
    return rows.select(
        "organization_id",
        "user_id",
        "email",
        "first_name",
        "last_name",
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("total_tasks", "active_tasks", "overdue_tasks")],
        estimated.cast("decimal(38,2)").alias("total_estimated_hours"),
        (minutes.cast("decimal(30,0)") / F.lit(60)).cast("decimal(30,4)").alias("total_logged_hours"),
    )


# -- task lists --------------------------------------------------------------------


def overdue_tasks(tasks: DataFrame, as_of, user=None, closed: Sequence[str] = CLOSED) -> DataFrame:
    """Open tasks past due by assignee and due date (of one user if given)."""
    rows = tasks.filter(F.col("assigned_to").isNotNull() if user is None else F.col("assigned_to") == F.lit(user))
    rows = rows.filter(~F.col("status").isin(*closed) & (F.col("due_date") < at(as_of)))
    return rows.orderBy(asc("assigned_to"), asc("due_date"), asc("task_id"))


def tasks_of_user(tasks: DataFrame, user=None, status: str | None = None) -> DataFrame:
    rows = tasks.filter(F.col("assigned_to").isNotNull() if user is None else F.col("assigned_to") == F.lit(user))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(asc("assigned_to"), asc("status"), asc("due_date"), asc("task_id"))


def project_tasks(tasks: DataFrame, project=None) -> DataFrame:
    rows = tasks.filter(F.col("project_id").isNotNull() if project is None else F.col("project_id") == F.lit(project))
    return rows.orderBy(asc("project_id"), asc("status"), asc("priority"), asc("due_date"), asc("task_id"))


def child_tasks(tasks: DataFrame, parent=None) -> DataFrame:
    rows = tasks.filter(
        F.col("parent_task_id").isNotNull() if parent is None else F.col("parent_task_id") == F.lit(parent)
    )
    return rows.orderBy(asc("parent_task_id"), asc("task_id"))


def dashboard(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks by organization, status, priority and due day."""
    open_tasks = tasks.filter(F.col("status") != "done")
    grouped = open_tasks.groupBy("organization_id", "status", "priority", F.to_date("due_date").alias("due_day")).agg(
        F.count(F.lit(1)).alias("task_count")
    )
    return grouped.orderBy(asc("organization_id"), asc("status"), asc("priority"), asc("due_day"))


def open_past_due(tasks: DataFrame, as_of, status: str = "open") -> DataFrame:
    """Tasks in one status past due. The given example uses 'open', which is
    not in the vocabulary, so callers name the status they mean."""
    return tasks.filter((F.col("status") == status) & (F.col("due_date") < at(as_of)))


# -- time and completion ---------------------------------------------------------


def hours_by_project(logs: DataFrame, tasks: DataFrame, projects: DataFrame, organization=None) -> DataFrame:
    """Hours of finished logs per project name.

    Seconds are summed per task before the joins: a task with a third of all
    logs is one row by then, and the shuffle carries task totals only.
    """
    spent = seconds_between(F.col("start_time"), F.col("end_time"))
    per_task = (
        logs.filter(F.col("end_time").isNotNull())
        .groupBy("task_id")
        .agg(F.sum(spent).alias("seconds"))
    )
    wanted = tasks if organization is None else tasks.filter(F.col("organization_id") == F.lit(organization))
    per_project = (
        wanted.select("task_id", "project_id")
        .join(per_task, "task_id")
        .groupBy("project_id")
        .agg(F.sum("seconds").alias("seconds"))
    )
    named = per_project.join(projects.select("project_id", "name"), "project_id")
    hours = (F.sum("seconds").cast("decimal(24,6)") / F.lit(3600)).cast("decimal(20,4)")
    return named.groupBy(F.col("name").alias("project_name")).agg(hours.alias("hours_logged"))


def _finished(logs: DataFrame, start, end, month: str) -> DataFrame:
    minutes = minutes_between(F.col("start_time"), F.col("end_time")).cast("bigint")
    return in_months(logs, "start_time", start, end, month).filter(F.col("end_time").isNotNull()).withColumn("__minutes", minutes)


def time_by_user_day(logs: DataFrame, start=None, end=None, month: str = "start_month") -> DataFrame:
    """Logs that started from `start` to before `end`; of a table stored by
    `month` only those months are read. So for the two reports below."""
    return (
        _finished(logs, start, end, month)
        .groupBy("user_id", F.to_date("start_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("log_count"), F.sum("__minutes").alias("total_minutes"))
    )


def billable_by_month(logs: DataFrame, start=None, end=None, month: str = "start_month") -> DataFrame:
    minutes = minutes_between(F.col("start_time"), F.col("end_time")).cast("bigint")
    return (
        in_months(logs, "start_time", start, end, month)
        .filter(F.col("billable"))
        .groupBy("organization_id", month_of(F.col("start_time")).alias("month"))
        .agg(F.count(F.lit(1)).alias("log_count"), F.coalesce(F.sum(minutes), F.lit(0)).alias("total_minutes"))
    )


def time_by_org_day(logs: DataFrame, start=None, end=None, month: str = "start_month") -> DataFrame:
    return (
        _finished(logs, start, end, month)
        .groupBy("organization_id", F.to_date("start_time").alias("day"), "billable")
        .agg(F.count(F.lit(1)).alias("log_count"), F.sum("__minutes").alias("total_minutes"))
    )


def completion_by_day(tasks: DataFrame) -> DataFrame:
    return (
        tasks.filter(F.col("status") == "done")
        .groupBy("organization_id", F.to_date("completed_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("completed_count"), total(F.col("actual_hours")).cast("decimal(20,2)").alias("actual_hours"))
    )


def due_by_quarter(tasks: DataFrame) -> DataFrame:
    return (
        tasks.filter(F.col("due_date").isNotNull())
        .groupBy("organization_id", F.quarter("due_date").alias("due_quarter"), F.year("due_date").alias("due_year"))
        .agg(F.count(F.lit(1)).alias("task_count"))
    )


# -- other access paths ---------------------------------------------------------


def unread_notifications(notifications: DataFrame, user=None) -> DataFrame:
    rows = notifications.filter(~F.col("is_read"))
    if user is not None:
        rows = rows.filter(F.col("user_id") == F.lit(user))
    return rows.orderBy(asc("user_id"), desc("created_at"), asc("notification_id"))


def due_notifications(notifications: DataFrame, as_of) -> DataFrame:
    """Scheduled notifications whose time has come and that are still unread."""
    rows = notifications.filter(~F.col("is_read") & (F.col("scheduled_for") <= at(as_of)))
    return rows.orderBy(asc("scheduled_for"), asc("notification_id"))


def audit_trail(audit: DataFrame, entity_type: str, entity_id=None) -> DataFrame:
    rows = audit.filter(F.col("entity_type") == entity_type)
    if entity_id is not None:
        rows = rows.filter(F.col("entity_id") == F.lit(entity_id))
    return rows.orderBy(asc("entity_id"), desc("created_at"), desc("log_id"))


def active_projects(projects: DataFrame) -> DataFrame:
    rows = live(projects).filter(F.col("status") == "active")
    return rows.orderBy(asc("organization_id"), asc("project_id"))


def recent_comments(comments: DataFrame, task=None) -> DataFrame:
    rows = live(comments)
    if task is not None:
        rows = rows.filter(F.col("task_id") == F.lit(task))
    return rows.orderBy(asc("task_id"), desc("created_at"), desc("comment_id"))


def recent_users(users: DataFrame) -> DataFrame:
    """Active users, last login first."""
    return users.filter(F.col("status") == "active").orderBy(desc("last_login_at"), asc("user_id"))


def users_by_status(users: DataFrame) -> DataFrame:
    rows = live(users) if "deleted_at" in users.columns else users
    return rows.groupBy("organization_id", "status").agg(F.count(F.lit(1)).alias("user_count"))


def find_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.lower("email") == F.lower(F.lit(email)))


def tasks_by_tag(tasks: DataFrame, task_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Live tags with how many tasks and how many open tasks carry them."""
    names = (live(tags) if "deleted_at" in tags.columns else tags).select("tag_id", F.col("name").alias("tag_name"))
    per_tag = (
        task_tags.select("task_id", "tag_id")
        .join(tasks.select("task_id", "status"), "task_id")
        .groupBy("tag_id")
        .agg(F.count(F.lit(1)).alias("task_count"), F.count_if(F.col("status") != "done").alias("open_count"))
    )
    return names.join(per_tag, "tag_id", "left").select(
        "tag_id",
        "tag_name",
        F.coalesce("task_count", F.lit(0)).alias("task_count"),
        F.coalesce("open_count", F.lit(0)).alias("open_count"),
    )


# -- batch log ----------------------------------------------------------------------

_COUNTERS = ("records_processed", "records_inserted", "records_updated", "records_failed")


def latest_batch(batches: DataFrame) -> DataFrame:
    """The batch that started last; duration is NULL while it runs."""
    took = seconds_between(F.col("batch_start_time"), F.col("batch_end_time")).cast("decimal(10,2)")
    newest = batches.orderBy(desc("batch_start_time"), desc("batch_id")).limit(1)
    counters = [c for c in _COUNTERS if c in batches.columns]
    return newest.select(
        "batch_id", "batch_start_time", "batch_end_time", "status", took.alias("duration_seconds"), *counters
    )


def batch_status(batches: DataFrame, as_of, hours_back: int = 24) -> DataFrame:
    """Batches started in the last hours, newest first, minutes not rounded."""
    took = seconds_between(F.col("batch_start_time"), F.col("batch_end_time")) / F.lit(60).cast("decimal(3,1)")
    recent = batches.filter(since(F.col("batch_start_time"), hours_back, as_of))
    more = [c for c in ("records_processed", "error_message") if c in batches.columns]
    return recent.select(
        "batch_id", "batch_start_time", "batch_end_time", "status", took.alias("duration_minutes"), *more
    ).orderBy(desc("batch_start_time"), desc("batch_id"))
