"""Queries over tables that are written first: pruned months, orders of rows, repeated loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.operators import aggregates, facts, scd2
from workmill.operators.calendar import dim_time
from workmill.plans import reports
from workmill.plans.registered_warehouse import log_facts
from workmill.plans.registry import AS_OF, DONE, ORACLES, query
from workmill.plans.workflow import Config, run_workflow
from workmill.session import shared_folder
from workmill.sources import layout, tables
from workmill.sources.dimension import DimensionTable
from workmill.sources.parts import Parts
from workmill.sources.profile import Profile

_MINUTES = "CAST(round((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0) AS BIGINT) // 60"


def _folder(x) -> str:
    return f"{shared_folder(x.spark)}/{x.spark.sparkContext.applicationId}/{uuid.uuid4()}"


def _by_month(x, rows: DataFrame, ts: str, month: str) -> DataFrame:
    """The rows, written by month and read back."""
    table = Parts(x.spark, _folder(x), month)
    table.commit(tables.month_partition(rows, ts, month), layout=lambda df: layout.sorted_within(df, [month], [ts]))
    return table.read()


def _logs(x) -> DataFrame:
    return _by_month(x, x["f_time_logs"], "start_time", "start_month")


@query(
    "stored_time_by_day",
    f"""SELECT user_id, CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, count(*) AS log_count, CAST(sum({_MINUTES}) AS BIGINT) AS total_minutes
        FROM {{f_time_logs}} WHERE end_time IS NOT NULL AND start_time >= TIMESTAMP '1996-03-10' AND start_time < TIMESTAMP '1996-06-01' GROUP BY 1, 2""",
)
def stored_time_by_day(x):
    """Three of the months of a stored log table."""
    return reports.time_by_user_day(_logs(x), "1996-03-10", "1996-06-01")


@query(
    "stored_billable_spring",
    f"""SELECT organization_id, CAST(CAST(date_trunc('month', start_time) AS DATE) AS VARCHAR) AS month, count(*) AS log_count,
               CAST(coalesce(sum({_MINUTES}), 0) AS BIGINT) AS total_minutes
        FROM {{f_time_logs}} WHERE billable AND quarter(start_time) = 2 GROUP BY 1, 2""",
)
def stored_billable_spring(x):
    """Second quarters by the calendar: months known at run time."""
    spring = dim_time(x.spark, "1992-01-01", "2002-12-31").filter("quarter_number = 2")
    return reports.billable_by_month(tables.in_calendar(_logs(x), spring, "start_month"))


@query(
    "stored_retention",
    "SELECT task_id, user_id, start_time, billable FROM {f_time_logs} WHERE start_time >= TIMESTAMP '1998-08-03 00:00:00'",
)
def stored_retention(x):
    return tables.retention(_logs(x), "start_time", 90, "1998-11-01", "start_month").select("task_id", "user_id", "start_time", "billable")


@query("stored_user_workload", ORACLES["agg_user_workload"])
def stored_user_workload(x):
    """The workload aggregate over a time-log fact stored by month."""
    fact = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, **DONE)
    logs = _by_month(x, log_facts(x), "start_timestamp", "start_month")
    rows = aggregates.user_workload_agg(fact, logs, x.dims.status, x.dims.time, AS_OF, days=30, **DONE)
    return rows.drop("etl_batch_id", "etl_timestamp")


@query(
    "space_filling_layout",
    """SELECT task_id, assigned_to, created_at FROM {f_tasks}
       WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1996-01-01' AND assigned_to BETWEEN 100 AND 400""",
)
def space_filling_layout(x):
    """A range of two keys, from a table in the order of their interleaved bits."""
    path = _folder(x)
    rows = x["f_tasks"].select("task_id", "assigned_to", "created_at")
    layout.space_filling(rows, ["assigned_to", "created_at"]).write.parquet(path)
    stored = x.spark.read.schema(rows.schema).parquet(path)
    return tables.in_months(stored, "created_at", "1995-01-01", "1996-01-01").filter(F.col("assigned_to").between(100, 400))


_USERS_TWICE = """
    WITH a AS (SELECT * FROM {f_users} WHERE user_id % 10 <> 0), s AS (SELECT * FROM {f_src_users}),
    j AS (SELECT coalesce(a.user_id, s.user_id) AS user_id, a.role AS old_role, s.role AS new_role, a.department AS old_department, s.department AS new_department,
                 CASE WHEN s.user_id IS NULL THEN 'deleted' WHEN a.user_id IS NULL THEN 'new'
                      WHEN a.email IS DISTINCT FROM s.email OR a.first_name IS DISTINCT FROM s.first_name OR a.last_name IS DISTINCT FROM s.last_name
                        OR a.role IS DISTINCT FROM s.role OR a.status IS DISTINCT FROM s.status THEN 'changed' ELSE 'unchanged' END AS kind
          FROM a FULL JOIN s ON a.user_id = s.user_id)
    SELECT user_id, old_role AS role, old_department AS department, 1 AS version_number, TIMESTAMP '1999-01-01 00:00:00' AS effective_date,
           CASE WHEN kind <> 'unchanged' THEN TIMESTAMP '2000-01-01 09:59:59' END AS expiry_date, kind = 'unchanged' AS is_current, 'B0' AS etl_batch_id
    FROM j WHERE kind <> 'new'
    UNION ALL
    SELECT user_id, new_role, new_department, CASE kind WHEN 'changed' THEN 2 ELSE 1 END, TIMESTAMP '2000-01-01 10:00:00', NULL, TRUE, 'B1'
    FROM j WHERE kind IN ('new', 'changed')"""


@query("dimension_two_loads", _USERS_TWICE)
def dimension_two_loads(x):
    """The stored user dimension after a first load and one with changes."""
    table = DimensionTable(x.spark, _folder(x), scd2.USERS)
    table.load(x["f_users"].filter("user_id % 10 <> 0"), "1999-01-01 00:00:00", "B0")
    table.load(x["f_src_users"], AS_OF, "B1")
    return table.read().select("user_id", "role", "department", "version_number", "effective_date", "expiry_date", "is_current", "etl_batch_id")


def _two_runs(x) -> tuple[Config, str]:
    """A warehouse after two full runs; a 37th of the tasks have no creation time."""

    def tasks(name):
        return x[name].withColumn("created_at", F.when(F.col("task_id") % 37 != 0, F.col("created_at")))

    sources = {
        "users": x["f_users"],
        "projects": x["f_projects"].withColumnRenamed("name", "project_name"),
        "task_status": x["f_task_status"].drop("status_key"),
        "priority": x["f_priority"].drop("priority_key"),
        "tasks": tasks("f_old_tasks"),
        "time_logs": x["f_time_logs"].withColumn("log_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("task_id", "user_id", "start_time", "hourly_rate", "end_time")])),
    }
    cfg = Config(x.spark, _folder(x), lambda name: sources[name], "1999-12-31 10:00:00", ("1992-01-01", "2002-12-31"), **DONE)
    run_workflow(cfg)
    sources |= {"tasks": tasks("f_src_tasks"), "users": x["f_src_users"]}
    cfg.as_of = AS_OF
    return cfg, run_workflow(cfg)


@query(
    "workflow_two_runs",
    """SELECT s.task_id, s.title, s.priority,
              CASE WHEN s.task_id % 37 <> 0 THEN CAST(CAST(date_trunc('month', s.created_at) AS DATE) AS VARCHAR) END AS created_month,
              s.task_id % 9 = 0 OR (s.task_id % 8 = 0 AND o.priority <> 'low') AS second_run
       FROM {f_src_tasks} s JOIN {f_tasks} o ON o.task_id = s.task_id""",
)
def workflow_two_runs(x):
    """The task fact after a second run that changed some rows and added some."""
    cfg, last = _two_runs(x)
    steps = cfg.log.batches().filter(F.col("parent_batch_id") == last).select(F.col("batch_id").alias("etl_batch_id"), F.lit(True).alias("second"))
    names = cfg.table("dim_priority").read().select("priority_key", F.col("priority_id").alias("priority"))
    rows = cfg.fact("fact_tasks").read().join(names, "priority_key", "left").join(steps, "etl_batch_id", "left")
    return rows.select("task_id", "title", "priority", "created_month", F.coalesce("second", F.lit(False)).alias("second_run"))


@query(
    "workflow_log",
    """
    WITH t AS (SELECT s.task_id % 9 = 0 AS is_new, s.task_id % 9 <> 0 AND s.task_id % 8 = 0 AND o.priority <> 'low' AS is_changed
               FROM {f_src_tasks} s JOIN {f_tasks} o ON o.task_id = s.task_id),
    u AS (SELECT s.user_id IS NULL AS gone, s.user_id IS NOT NULL AND a.role IS DISTINCT FROM s.role AS is_changed FROM {f_users} a LEFT JOIN {f_src_users} s ON s.user_id = a.user_id)
    SELECT 'FACT_TASKS_LOAD' AS source_system, 'COMPLETED' AS status, count(*) AS records_processed, count(*) FILTER (WHERE is_new) AS records_inserted,
           count(*) FILTER (WHERE is_changed) AS records_updated FROM t
    UNION ALL
    SELECT 'DIM_USERS_LOAD', 'COMPLETED', count(*) + count(*) FILTER (WHERE is_changed), count(*) FILTER (WHERE is_changed), count(*) FILTER (WHERE gone OR is_changed) FROM u""",
)
def workflow_log(x):
    """What the second run's log says of two of its steps."""
    cfg, last = _two_runs(x)
    steps = cfg.log.batches().filter((F.col("parent_batch_id") == last) & F.col("source_system").isin("FACT_TASKS_LOAD", "DIM_USERS_LOAD"))
    return steps.select("source_system", "status", "records_processed", "records_inserted", "records_updated")


_PROFILED = "task_id organization_id project_id parent_task_id title status priority created_at due_date actual_hours assigned_to".split()


def _shown(c: str) -> str:
    if c.endswith("_at") or c == "due_date":
        return f"strftime({{0}}({c}), '%Y-%m-%d %H:%M:%S')"
    return f"CAST({{0}}({c}) AS VARCHAR)"


@query(
    "profile_of_loads",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, TRUE AS distinct_close, "
        f"{_shown(c).format('min')} AS min_value, {_shown(c).format('max')} AS max_value, {'FALSE' if c in ('title', 'status', 'priority') else 'TRUE'} AS median_inside FROM {{f_src_tasks}}"
        for c in _PROFILED
    ),
)
def profile_of_loads(x):
    """The merged profile of a table written in two loads, the second seen alone."""
    rows = tables.month_partition(x["f_src_tasks"].select(*_PROFILED), "created_at", "created_month")
    table = Parts(x.spark, _folder(x), "created_month")
    profile = Profile(x.spark, _folder(x), table)
    for part in ("task_id % 9 <> 0", "task_id % 9 = 0"):
        table.commit(rows.filter(part))
        profile.refresh()
    found = profile.read().filter("column_name <> 'created_month'")
    exact = tables.table_profile(rows.select(*_PROFILED), exact=True).select("column_name", F.col("distinct_count").alias("exact"))
    # Sketched distinct counts are off by 5 % at most here, and medians lie between the ends.
    inside = F.coalesce(F.col("quantiles")[1].between(F.col("quantiles")[0], F.col("quantiles")[2]), F.lit(False))
    return found.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", (F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_close"), "min_value", "max_value", inside.alias("median_inside")
    )
