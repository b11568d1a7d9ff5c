"""Measures derived from one task row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.functions.moments import on, whole_days

MEASURES = (
    "days_open",
    "days_in_progress",
    "days_in_review",
    "days_completed",
    "is_overdue",
    "days_overdue",
    "completion_ratio",
)


def task_measures(
    as_of,
    completed: Sequence[str] = ("completed",),
    closed: Sequence[str] = ("completed", "cancelled"),
) -> dict[str, Column]:
    """Measure name -> expression over the source task columns.

    The status literals default to those of the loader; the source model ends
    in 'done', so its callers pass ("done",) and ("done", "cancelled").
    """
    today = on(as_of)
    status = F.col("status")

    def days_while(condition: Column, since: str) -> Column:
        return F.when(condition, whole_days(F.col(since), today)).otherwise(F.lit(0))

    finished = status.isin(*completed)
    # NULL status makes the test NULL, which falls through to FALSE / 0.
    still_due = F.col("due_date").isNotNull() & ~status.isin(*closed)
    spent, planned = F.col("actual_hours"), F.col("estimated_hours")
    progress = F.least(F.lit(99.9).cast("decimal(4,1)"), spent / F.nullif(planned, F.lit(0).cast("decimal(10,2)")) * 100)
    return {
        "days_open": whole_days(F.col("created_at"), today),
        "days_in_progress": days_while(status == "in_progress", "status_changed_at"),
        "days_in_review": days_while(status == "in_review", "status_changed_at"),
        "days_completed": days_while(finished, "completed_at"),
        "is_overdue": F.when(still_due, F.col("due_date") < today.cast("timestamp_ntz")).otherwise(F.lit(False)),
        "days_overdue": F.when(still_due, F.greatest(F.lit(0), whole_days(F.col("due_date"), today))).otherwise(F.lit(0)),
        "completion_ratio": F.when(finished, F.lit(100))
        .when((planned > 0) & (spent > 0), progress)
        .otherwise(F.lit(0))
        .cast("decimal(5,2)"),
    }


def with_measures(tasks: DataFrame, as_of, **statuses) -> DataFrame:
    return tasks.withColumns(task_measures(as_of, **statuses))
