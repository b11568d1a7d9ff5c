"""Aggregate tables. Only their columns are given; the formulae are ours."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.functions.moments import at, on, parse
from workmill.functions.scalars import amount, mean, ratio, total
from workmill.sources.tables import in_months


def _snapshot_key(time: DataFrame, as_of):
    """The date key of `as_of`, as a scalar subquery over the date dimension."""
    return time.filter(F.col("full_date") == on(as_of)).select(F.max("time_key")).scalar()


def _with_status(fact: DataFrame, status: DataFrame) -> DataFrame:
    names = status.filter(F.col("is_current")).select("status_key", "status_id")
    return fact.join(names, "status_key", "left")


def daily_task_metrics(
    fact: DataFrame,
    status: DataFrame,
    time: DataFrame,
    as_of,
    completed: Sequence[str] = ("completed",),
    closed: Sequence[str] = ("completed", "cancelled"),
    batch_id: str | None = None,
    tenant: Sequence[str] = (),
) -> DataFrame:
    """Snapshot of the task fact by project, status and priority, and by the
    `tenant` columns if asked.

    open: status known and not closed. Days to complete: calendar days from the
    created to the completed date key, over completed tasks. Ratio: completed
    of all. The status dimension is a closed vocabulary.
    """
    day = {
        side: F.broadcast(time.select(F.col("time_key").alias(f"{side}_date_key"), F.col("full_date").alias(f"__{side}")))
        for side in ("created", "completed")
    }
    rows = _with_status(fact, status).join(day["created"], "created_date_key", "left").join(day["completed"], "completed_date_key", "left")
    done = F.col("status_id").isin(*completed)
    is_open = ~F.col("status_id").isin(*closed)
    out = rows.groupBy(*tenant, "project_key", "status_key", "priority_key").agg(
        F.count(F.lit(1)).cast("int").alias("task_count"),
        F.count_if(is_open).cast("int").alias("open_tasks"),
        F.count_if(F.col("status_id") == "in_progress").cast("int").alias("in_progress_tasks"),
        F.count_if(done).cast("int").alias("completed_tasks"),
        F.count_if("is_blocked").cast("int").alias("blocked_tasks"),
        F.count_if("is_overdue").cast("int").alias("overdue_tasks"),
        mean(F.col("days_open")).alias("avg_days_open"),
        mean(F.when(done, F.date_diff("__completed", "__created"))).alias("avg_days_to_complete"),
        total(F.col("story_points")).cast("int").alias("total_story_points"),
        total(F.when(done, F.col("story_points"))).cast("int").alias("completed_story_points"),
    )
    return out.select(
        _snapshot_key(time, as_of).alias("date_key"),
        "*",
        ratio(F.col("completed_tasks"), F.col("task_count"), precision=5).alias("completion_ratio"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        at(as_of).alias("etl_timestamp"),
    )


def user_workload_agg(
    fact: DataFrame,
    logs: DataFrame,
    status: DataFrame,
    time: DataFrame,
    as_of,
    days: int = 1,
    completed: Sequence[str] = ("completed",),
    closed: Sequence[str] = ("completed", "cancelled"),
    batch_id: str | None = None,
    tenant: Sequence[str] = (),
) -> DataFrame:
    """Per user and project (and `tenant` columns): tasks as they stand, hours of the last `days` days.

    Tasks and hours are reduced separately to one row per (user, project) and
    then joined, so neither multiplies the other. Of logs stored by start_month
    only the months of those days are read.
    """
    key = [*tenant, "user_key", "project_key"]
    done = F.col("status_id").isin(*completed)
    tasks = (
        _with_status(fact, status)
        .groupBy(*tenant, F.col("assigned_to_key").alias("user_key"), "project_key")
        .agg(
            F.count(F.lit(1)).alias("assigned_tasks"),
            F.count_if(done).alias("completed_tasks"),
            F.count_if(~F.col("status_id").isin(*closed)).alias("open_tasks"),
            F.count_if(F.col("status_id") == "in_progress").alias("in_progress_tasks"),
            F.count_if("is_overdue").alias("overdue_tasks"),
        )
    )
    midnight = parse(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    recent = in_months(logs, "start_timestamp", midnight - timedelta(days=days - 1), midnight + timedelta(days=1), "start_month")
    hours = recent.groupBy(*key).agg(
        F.sum("duration_hours").alias("total_hours_logged"), F.sum("billable_hours").alias("billable_hours")
    )
    t, h = tasks.alias("t"), hours.alias("h")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key]
    both = t.join(h, same, "full").filter(F.coalesce("t.user_key", "h.user_key").isNotNull())
    count = {c: F.coalesce(c, F.lit(0)) for c in ("assigned_tasks", "completed_tasks", "open_tasks", "in_progress_tasks", "overdue_tasks")}
    logged, billed = F.coalesce("total_hours_logged", F.lit(0)), F.coalesce("billable_hours", F.lit(0))
    return both.select(
        _snapshot_key(time, as_of).alias("date_key"),
        *[F.coalesce(f"t.{c}", f"h.{c}").alias(c) for c in tenant],
        F.coalesce("t.user_key", "h.user_key").alias("user_key"),
        F.coalesce("t.project_key", "h.project_key").alias("project_key"),
        *[c.cast("int").alias(n) for n, c in count.items()],
        amount(logged).alias("total_hours_logged"),
        amount(logged / F.nullif(count["assigned_tasks"], F.lit(0))).alias("avg_hours_per_task"),
        amount(billed).alias("billable_hours"),
        amount(logged - billed).alias("non_billable_hours"),
        ratio(billed, logged, precision=5).alias("utilization_percentage"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        at(as_of).alias("etl_timestamp"),
    )
