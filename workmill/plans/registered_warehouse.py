"""Queries over the warehouse loads: calendar, dimensions, facts, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmill.functions.keys import assign_keys
from workmill.functions.measures import MEASURES, task_measures
from workmill.operators import aggregates, facts, scd2
from workmill.operators.calendar import dim_time_covering
from workmill.operators.lookup import lookup_as_of, lookup_as_of_merge
from workmill.operators.merge import diff_kinds, merge_update
from workmill.plans.registry import AS_OF, DONE, dec, half_up, query
from workmill.sources import tables

NOW = "TIMESTAMP '2000-01-01 10:00:00'"
MIDNIGHT = "TIMESTAMP '2000-01-01 00:00:00'"


def key_of(ts: str) -> str:
    """Date key in a calendar that starts in 1995."""
    return f"CAST(date_diff('day', DATE '1995-01-01', CAST({ts} AS DATE)) + 1 AS INTEGER)"


def days(ts: str) -> str:
    return f"CAST(trunc((epoch_us({MIDNIGHT}) - epoch_us({ts})) / 86400000000.0) AS INTEGER)"


_MEASURES = f"""
  {days('created_at')} AS days_open,
  CASE WHEN status = 'in_progress' THEN {days('status_changed_at')} ELSE 0 END AS days_in_progress,
  CASE WHEN status = 'in_review' THEN {days('status_changed_at')} ELSE 0 END AS days_in_review,
  CASE WHEN status = 'done' THEN {days('completed_at')} ELSE 0 END AS days_completed,
  coalesce(due_date < {MIDNIGHT} AND status NOT IN ('done', 'cancelled'), FALSE) AS is_overdue,
  CASE WHEN due_date IS NULL OR status IN ('done', 'cancelled') THEN 0
       ELSE greatest(0, {days('due_date')}) END AS days_overdue,
  CAST(CASE WHEN status = 'done' THEN 100
            WHEN estimated_hours > 0 AND actual_hours > 0
            THEN least(99.9, CAST(actual_hours AS DOUBLE) * 100 / CAST(estimated_hours AS DOUBLE))
            ELSE 0 END AS DECIMAL(5,2)) AS completion_ratio"""

_KEYS = f"""
  project_id + 1 AS project_key, assigned_to + 1 AS assigned_to_key, reporter_id + 1 AS reporter_key,
  s.status_key, p.priority_key, {key_of('created_at')} AS created_date_key,
  coalesce({key_of('due_date')}, -1) AS due_date_key, coalesce({key_of('completed_at')}, -1) AS completed_date_key"""

_JOINS = "LEFT JOIN {f_task_status} s ON t.status = s.status_id LEFT JOIN {f_priority} p ON t.priority = p.priority_id"

# Fact rows of a task projection, as a CTE body.
_FACT = (
    "SELECT t.task_id, t.task_sk, t.title, t.estimated_hours, t.actual_hours, t.story_points, t.is_blocked, "
    "t.parent_task_id, t.created_at AS created_timestamp, t.organization_id, t.status, "
    + _KEYS
    + ","
    + _MEASURES
    + " FROM {%s} t "
    + _JOINS
)

_FACT_COLS = [
    "task_id",
    "task_sk",
    "project_key",
    "assigned_to_key",
    "reporter_key",
    "status_key",
    "priority_key",
    "created_date_key",
    "due_date_key",
    "completed_date_key",
    "title",
    "estimated_hours",
    "actual_hours",
    "story_points",
    "is_blocked",
    "parent_task_id",
    "created_timestamp",
    *MEASURES,
]


def _shown(alias: str = "f") -> str:
    """The fact columns with the types the Spark side has."""
    out = []
    for c in _FACT_COLS:
        if c in ("estimated_hours", "actual_hours", "story_points", "completion_ratio"):
            out.append(f"CAST({alias}.{c} AS DOUBLE) AS {c}")
        elif c.endswith("_key"):
            out.append(f"CAST({alias}.{c} AS INTEGER) AS {c}")
        else:
            out.append(f"{alias}.{c}")
    return ", ".join(out)


# -- calendar --------------------------------------------------------------------


@query(
    "dim_time",
    """
    WITH b AS (SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS lo,
                      CAST(date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR AS DATE) AS hi FROM orders),
    d AS (SELECT lo, CAST(unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
    n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS task_count FROM orders GROUP BY 1)
    SELECT CAST(date_diff('day', lo, d.day) + 1 AS INTEGER) AS time_key, CAST(d.day AS VARCHAR) AS full_date,
           CAST(dayofweek(d.day) AS SMALLINT) AS day_of_week, rpad(dayname(d.day), 9, ' ') AS day_name,
           CAST(day(d.day) AS SMALLINT) AS day_of_month, CAST(dayofyear(d.day) AS SMALLINT) AS day_of_year,
           CAST(week(d.day) AS SMALLINT) AS week_of_year, CAST(month(d.day) AS SMALLINT) AS month_number,
           rpad(monthname(d.day), 9, ' ') AS month_name, CAST(quarter(d.day) AS SMALLINT) AS quarter_number,
           CAST(year(d.day) AS INTEGER) AS year_number, dayofweek(d.day) IN (0, 6) AS is_weekend,
           strftime(d.day, '%Y-%m-%d') = '1997-07-04' AS is_holiday,
           CASE WHEN strftime(d.day, '%Y-%m-%d') = '1997-07-04' THEN 'Independence Day' END AS holiday_name,
           CAST(d.day AS VARCHAR) AS effective_date, CAST(NULL AS VARCHAR) AS expiry_date, TRUE AS is_current,
           coalesce(task_count, 0) AS task_count
    FROM d LEFT JOIN n USING (day)
    """,
)
def dim_time_query(x):
    """Calendar over the years the tasks span, with tasks created per day."""
    tasks = x["f_tasks"]
    dim = dim_time_covering(tasks, "created_at", {"1997-07-04": "Independence Day"})
    per_day = tasks.groupBy(F.to_date("created_at").alias("full_date")).agg(F.count(F.lit(1)).alias("task_count"))
    return dim.join(per_day, "full_date", "left").withColumn("task_count", F.coalesce("task_count", F.lit(0)))


# -- measures and task facts ---------------------------------------------------------


@query("task_measures", "SELECT task_id, " + _MEASURES.replace("AS DECIMAL(5,2)) AS completion_ratio", "AS DECIMAL(5,2))::DOUBLE AS completion_ratio") + " FROM {f_tasks}")
def measures_query(x):
    return x["f_tasks"].select("task_id", *[c.alias(n) for n, c in task_measures(AS_OF, **DONE).items()])


@query(
    "task_measures_by_key",
    "WITH f AS (" + _FACT % "f_tasks" + """)
    SELECT created_date_key, due_date_key = -1 AS no_due_date, completed_date_key = -1 AS not_completed,
           count(*) AS task_count, CAST(sum(days_open) AS BIGINT) AS days_open
    FROM f GROUP BY 1, 2, 3""",
)
def measures_by_key(x):
    """Facts with unknown-date keys, by creation day."""
    rows = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, **DONE)
    return rows.groupBy(
        "created_date_key",
        (F.col("due_date_key") == -1).alias("no_due_date"),
        (F.col("completed_date_key") == -1).alias("not_completed"),
    ).agg(F.count(F.lit(1)).alias("task_count"), F.sum("days_open").alias("days_open"))


def _stored(x):
    """The stored fact: the older tasks, keyed by their id."""
    rows = facts.resolve_tasks(x["f_old_tasks"], x.dims, AS_OF, "B0", **DONE)
    return rows.withColumn("task_key", F.col("task_id") + 1)


def _fact_load(x):
    return facts.load_fact_tasks(_stored(x), x["f_src_tasks"], x.dims, AS_OF, "B1", **DONE)


_CHANGED = "s.task_id % 9 <> 0 AND s.task_id % 8 = 0 AND o.priority <> 'low'"


@query("fact_tasks_new", "WITH f AS (" + _FACT % "f_src_tasks" + ") SELECT " + _shown() + " FROM f WHERE task_id % 9 = 0")
def fact_tasks_new(x):
    return _fact_load(x).of("new").select(*_FACT_COLS)


@query(
    "fact_tasks_changed",
    "WITH f AS (" + _FACT % "f_src_tasks" + ") SELECT f.task_id + 1 AS task_key, " + _shown()
    + " FROM f JOIN {f_tasks} o ON o.task_id = f.task_id WHERE f.task_id % 9 <> 0 AND f.task_id % 8 = 0 AND o.priority <> 'low'",
)
def fact_tasks_changed(x):
    return _fact_load(x).of("changed").select("task_key", *_FACT_COLS)


@query(
    "fact_tasks_merged",
    "WITH f AS (" + _FACT % "f_src_tasks" + ") SELECT CASE WHEN f.task_id % 9 <> 0 THEN f.task_id + 1 END AS task_key, "
    + _shown()
    + ", CASE WHEN f.task_id % 9 = 0 OR (f.task_id % 8 = 0 AND o.priority <> 'low') THEN 'B1' ELSE 'B0' END AS etl_batch_id"
    + " FROM f JOIN {f_tasks} o ON o.task_id = f.task_id",
)
def fact_tasks_merged(x):
    load, _ = _fact_load(x).settled()
    return load.merged().select("task_key", *_FACT_COLS, "etl_batch_id")


@query(
    "fact_tasks_counts",
    """
    SELECT CASE WHEN task_id % 9 = 0 THEN 'new' WHEN task_id % 8 = 0 AND priority <> 'low' THEN 'changed'
                ELSE 'unchanged' END AS kind, count(*) AS row_count
    FROM {f_tasks} GROUP BY 1""",
)
def fact_tasks_counts(x):
    return _fact_load(x).counts()


@query(
    "merge_update",
    """
    SELECT t.task_id, t.title, CASE WHEN t.task_id % 8 = 0 THEN 'low' ELSE t.priority END AS priority, t.status,
           CASE WHEN t.task_id % 8 = 0 AND t.priority <> 'low' THEN TIMESTAMP '2000-01-01 10:00:00'
                ELSE t.created_at END AS updated_at,
           t.task_id % 8 = 0 AND t.priority <> 'low' AS was_updated
    FROM {f_old_tasks} t""",
)
def merge_update_query(x):
    """Keyed update with change test and touched updated_at."""
    target = x["f_old_tasks"].select("task_id", "title", "priority", "status", F.col("created_at").alias("updated_at"))
    return merge_update(
        target, x["f_src_tasks"], "task_id", ["priority", "title"], ["priority", "title"], as_of=AS_OF, mark="was_updated"
    )


@query(
    "snapshot_diff",
    """
    SELECT coalesce(a.task_id, b.task_id) AS task_id,
           CASE WHEN a.task_id IS NULL THEN 'new' WHEN b.task_id IS NULL THEN 'deleted'
                WHEN a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status THEN 'changed'
                ELSE 'unchanged' END AS kind
    FROM {f_old_tasks} a FULL JOIN (SELECT * FROM {f_src_tasks} WHERE status <> 'backlog') b ON a.task_id = b.task_id""",
)
def snapshot_diff(x):
    """Two snapshots; the later one has lost its backlog."""
    return diff_kinds(x["f_old_tasks"], x["f_src_tasks"].filter("status <> 'backlog'"), "task_id", ["priority", "status"])


@query(
    "task_history",
    """
    WITH j AS (
      SELECT coalesce(a.task_id, b.task_id) AS task_id, a.task_id IS NULL AS added, b.task_id IS NULL AS gone,
             a.status AS os, b.status AS ns, a.priority AS op, b.priority AS np,
             CAST(a.assigned_to AS VARCHAR) AS oa, CAST(b.assigned_to AS VARCHAR) AS na
      FROM {f_old_tasks} a FULL JOIN (SELECT * FROM {f_src_tasks} WHERE status <> 'backlog') b ON a.task_id = b.task_id),
    u AS (SELECT task_id, added, gone, 'status' AS field_changed, os AS old_value, ns AS new_value FROM j
          UNION ALL SELECT task_id, added, gone, 'priority', op, np FROM j
          UNION ALL SELECT task_id, added, gone, 'assigned_to', oa, na FROM j)
    SELECT task_id, field_changed, old_value, new_value,
           CASE WHEN added THEN 'INSERT' WHEN gone THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
           TIMESTAMP '2000-01-01 10:00:00' AS changed_timestamp
    FROM u WHERE old_value IS DISTINCT FROM new_value""",
)
def task_history_query(x):
    new = x["f_src_tasks"].filter("status <> 'backlog'")
    return facts.task_history(x["f_old_tasks"], new, "task_id", ["status", "priority", "assigned_to"], AS_OF)


# -- other facts ----------------------------------------------------------------------

_MINUTES = "CAST(round((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0) AS BIGINT) // 60"

_LOG_FACT = f"""
    SELECT l.task_id + 1 AS task_key, CAST(l.user_id + 1 AS INTEGER) AS user_key,
           CAST(t.project_id + 1 AS INTEGER) AS project_key, {key_of('l.start_time')} AS date_key,
           {key_of('l.start_time')} AS start_time_key, {key_of('l.end_time')} AS end_time_key,
           l.start_time AS start_timestamp, l.end_time AS end_timestamp,
           CAST(coalesce({_MINUTES}, 0) AS DECIMAL(10,2)) AS duration_minutes,
           CAST(coalesce({_MINUTES}, 0) / 60.0 AS DECIMAL(10,2)) AS duration_hours,
           l.hourly_rate AS billing_rate, l.billable AS is_billable
    FROM {{f_time_logs}} l JOIN {{f_tasks}} t ON l.task_id = t.task_id"""


def log_facts(x):
    tasks = x["f_tasks"].select("task_id", (F.col("task_id") + 1).alias("task_key"), (F.col("project_id") + 1).cast("int").alias("project_key"))
    return facts.load_fact_time_logs(x["f_time_logs"], tasks, x.dims.users, x.dims.time)


@query(
    "fact_time_logs",
    f"""
    WITH f AS ({_LOG_FACT})
    SELECT task_key, user_key, project_key, date_key, start_time_key, end_time_key, start_timestamp, end_timestamp,
           CAST(duration_minutes AS DOUBLE) AS duration_minutes, CAST(duration_hours AS DOUBLE) AS duration_hours,
           CASE WHEN is_billable THEN CAST(duration_hours AS DOUBLE) ELSE 0.0::DOUBLE END AS billable_hours,
           CAST(billing_rate AS DOUBLE) AS billing_rate,
           {dec("CASE WHEN is_billable THEN duration_hours * billing_rate ELSE 0 END")} AS billing_amount, is_billable
    FROM f""",
)
def fact_time_logs(x):
    return log_facts(x).select(
        "task_key",
        "user_key",
        "project_key",
        "date_key",
        "start_time_key",
        "end_time_key",
        "start_timestamp",
        "end_timestamp",
        "duration_minutes",
        "duration_hours",
        "billable_hours",
        "billing_rate",
        "billing_amount",
        "is_billable",
    )


@query(
    "bridge_assignees",
    f"""
    SELECT a.task_id + 1 AS task_key, CAST(a.user_id + 1 AS INTEGER) AS user_key,
           coalesce(t.assigned_to = a.user_id, FALSE) AS is_primary,
           {key_of('a.assigned_at')} AS assignment_date_key, a.assigned_at AS assignment_timestamp
    FROM {{f_assignments}} a JOIN {{f_tasks}} t ON a.task_id = t.task_id JOIN {{f_users}} u ON a.user_id = u.user_id""",
)
def bridge_assignees(x):
    keyed = x["f_tasks"].select("task_id", (F.col("task_id") + 1).alias("task_key"))
    rows = facts.load_bridge(x["f_assignments"], x["f_tasks"], keyed, x.dims.users, x.dims.time)
    return rows.drop("etl_batch_id", "etl_timestamp")


# -- aggregates -----------------------------------------------------------------------


@query(
    "agg_daily_task_metrics",
    "WITH f AS (" + _FACT % "f_tasks" + f""")
    SELECT {key_of(MIDNIGHT)} AS date_key, CAST(project_key AS INTEGER) AS project_key, status_key, priority_key,
           CAST(count(*) AS INTEGER) AS task_count,
           CAST(count(CASE WHEN status NOT IN ('done', 'cancelled') THEN 1 END) AS INTEGER) AS open_tasks,
           CAST(count(CASE WHEN status = 'in_progress' THEN 1 END) AS INTEGER) AS in_progress_tasks,
           CAST(count(CASE WHEN status = 'done' THEN 1 END) AS INTEGER) AS completed_tasks,
           CAST(count(CASE WHEN is_blocked THEN 1 END) AS INTEGER) AS blocked_tasks,
           CAST(count(CASE WHEN is_overdue THEN 1 END) AS INTEGER) AS overdue_tasks,
           {half_up('sum(days_open)', 'count(*)')} AS avg_days_open,
           {half_up("sum(CASE WHEN status = 'done' THEN completed_date_key - created_date_key END)", "count(CASE WHEN status = 'done' THEN 1 END)")} AS avg_days_to_complete,
           CAST(sum(story_points) AS INTEGER) AS total_story_points,
           CAST(coalesce(sum(CASE WHEN status = 'done' THEN story_points END), 0) AS INTEGER) AS completed_story_points,
           {half_up("100 * count(CASE WHEN status = 'done' THEN 1 END)", "count(*)")} AS completion_ratio
    FROM f GROUP BY project_key, status_key, priority_key""",
)
def agg_daily_task_metrics(x):
    fact = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, **DONE)
    rows = aggregates.daily_task_metrics(fact, x.dims.status, x.dims.time, AS_OF, **DONE)
    return rows.drop("etl_batch_id", "etl_timestamp")


@query(
    "agg_user_workload",
    "WITH f AS (" + _FACT % "f_tasks" + f"""),
    l AS ({_LOG_FACT}),
    t AS (SELECT assigned_to_key AS user_key, project_key, count(*) AS assigned,
                 count(CASE WHEN status = 'done' THEN 1 END) AS done,
                 count(CASE WHEN status NOT IN ('done', 'cancelled') THEN 1 END) AS unfinished,
                 count(CASE WHEN status = 'in_progress' THEN 1 END) AS going,
                 count(CASE WHEN is_overdue THEN 1 END) AS late
          FROM f WHERE assigned_to_key IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT user_key, project_key, sum(duration_hours) AS hours,
                 sum(CASE WHEN is_billable THEN duration_hours ELSE 0 END) AS billed
          FROM l WHERE start_timestamp >= TIMESTAMP '1999-12-03' AND start_timestamp < TIMESTAMP '2000-01-02' GROUP BY 1, 2)
    SELECT {key_of(MIDNIGHT)} AS date_key, CAST(coalesce(t.user_key, h.user_key) AS INTEGER) AS user_key,
           CAST(coalesce(t.project_key, h.project_key) AS INTEGER) AS project_key,
           CAST(coalesce(assigned, 0) AS INTEGER) AS assigned_tasks, CAST(coalesce(done, 0) AS INTEGER) AS completed_tasks,
           CAST(coalesce(unfinished, 0) AS INTEGER) AS open_tasks, CAST(coalesce(going, 0) AS INTEGER) AS in_progress_tasks,
           CAST(coalesce(late, 0) AS INTEGER) AS overdue_tasks, {dec('coalesce(hours, 0)')} AS total_hours_logged,
           {half_up('coalesce(hours, 0) * 100', 'assigned * 100')} AS avg_hours_per_task,
           {dec('coalesce(billed, 0)')} AS billable_hours,
           {dec('coalesce(hours, 0) - coalesce(billed, 0)')} AS non_billable_hours,
           {half_up('coalesce(billed, 0) * 10000', 'hours * 100')} AS utilization_percentage
    FROM t FULL JOIN h ON t.user_key IS NOT DISTINCT FROM h.user_key AND t.project_key IS NOT DISTINCT FROM h.project_key""",
)
def agg_user_workload(x):
    fact = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, **DONE)
    rows = aggregates.user_workload_agg(fact, log_facts(x), x.dims.status, x.dims.time, AS_OF, days=30, **DONE)
    return rows.drop("etl_batch_id", "etl_timestamp")


# -- dimensions --------------------------------------------------------------------------

_TRACKED_DIFF = "d.email IS DISTINCT FROM s.email OR d.first_name IS DISTINCT FROM s.first_name OR d.last_name IS DISTINCT FROM s.last_name OR d.role IS DISTINCT FROM s.role OR d.status IS DISTINCT FROM s.status"

_SCD2_KINDS = f"""
    WITH past AS (SELECT user_id, max(version_number) AS v FROM {{f_dim_users}} WHERE NOT is_current GROUP BY 1),
    j AS (SELECT coalesce(d.user_id, s.user_id) AS user_id,
                 CASE WHEN s.user_id IS NULL THEN 'deleted' WHEN d.user_id IS NULL AND past.v IS NOT NULL THEN 'returned'
                      WHEN d.user_id IS NULL THEN 'new' WHEN {_TRACKED_DIFF} THEN 'changed' ELSE 'unchanged' END AS kind
          FROM (SELECT * FROM {{f_dim_users}} WHERE is_current) d FULL JOIN {{f_src_users}} s ON d.user_id = s.user_id
          LEFT JOIN past ON past.user_id = s.user_id)"""


@query("scd2_counts", _SCD2_KINDS + " SELECT kind, count(*) AS row_count FROM j GROUP BY kind")
def scd2_counts(x):
    return scd2.scd2_counts(x["f_dim_users"], x["f_src_users"], scd2.USERS)


_VERSION_COLS = "user_id, username, email, first_name, last_name, role, status, department, manager_id, hire_date"


def _scd2_sql(reopen: bool) -> str:
    starts = "('new', 'changed', 'returned')" if reopen else "('new', 'changed')"
    shown = (
        "user_key, organization_id, user_id, username, email, first_name, last_name, role, status, department, manager_id, "
        "CAST(hire_date AS VARCHAR) AS hire_date, effective_date, expiry_date, is_current, "
        "CAST(version_number AS INTEGER) AS version_number, source_system, etl_batch_id, etl_timestamp"
    )
    return (
        _SCD2_KINDS
        + f""",
    ended AS (SELECT user_id FROM j WHERE kind IN ('deleted', 'changed')),
    old AS (SELECT d.* REPLACE (
                CASE WHEN d.is_current AND e.user_id IS NOT NULL THEN TIMESTAMP '2000-01-01 09:59:59' ELSE d.expiry_date END AS expiry_date,
                CASE WHEN d.is_current AND e.user_id IS NOT NULL THEN {NOW} ELSE d.etl_timestamp END AS etl_timestamp,
                d.is_current AND e.user_id IS NULL AS is_current)
            FROM {{f_dim_users}} d LEFT JOIN ended e ON d.user_id = e.user_id),
    top AS (SELECT user_id, max(version_number) AS v FROM {{f_dim_users}} GROUP BY 1),
    fresh AS (SELECT CAST(NULL AS INTEGER) AS user_key, s.organization_id, s.user_id, s.username, s.email, s.first_name, s.last_name,
                s.role, s.status, s.department, s.manager_id, s.hire_date, {NOW} AS effective_date,
                CAST(NULL AS TIMESTAMP) AS expiry_date, TRUE AS is_current, coalesce(top.v, 0) + 1 AS version_number,
                'OLTP' AS source_system, 'B1' AS etl_batch_id, {NOW} AS etl_timestamp
              FROM {{f_src_users}} s JOIN j ON j.user_id = s.user_id AND j.kind IN {starts} LEFT JOIN top ON top.user_id = s.user_id)
    SELECT {shown} FROM old UNION ALL SELECT {shown} FROM fresh"""
    )


@query("scd2_users", _scd2_sql(False))
def scd2_users(x):
    return scd2.scd2_merge(x["f_dim_users"], x["f_src_users"], scd2.USERS, AS_OF, "B1")


@query("scd2_users_reopen", _scd2_sql(True))
def scd2_users_reopen(x):
    return scd2.scd2_merge(x["f_dim_users"], x["f_src_users"], scd2.USERS, AS_OF, "B1", reopen=True)


_PROJECT_SRC = """SELECT p.project_id, p.name AS project_name,
       CASE WHEN count(t.task_id) FILTER (WHERE t.status = 'todo') * 10 > count(t.task_id) THEN 'active' ELSE p.status END AS status,
       p.start_date FROM {f_projects} p LEFT JOIN {f_tasks} t ON t.project_id = p.project_id
       GROUP BY p.project_id, p.name, p.status, p.start_date"""


@query(
    "scd2_projects",
    "WITH src AS (" + _PROJECT_SRC + f""")
    SELECT project_id, project_name, s.status, CAST(s.start_date AS VARCHAR) AS start_date, {NOW} AS effective_date,
           CAST(NULL AS TIMESTAMP) AS expiry_date, TRUE AS is_current, 2 AS version_number
    FROM src s JOIN {{f_projects}} p USING (project_id) WHERE p.status <> s.status
    UNION ALL
    SELECT project_id, p.name, p.status, CAST(p.start_date AS VARCHAR), TIMESTAMP '1999-01-01 00:00:00',
           CASE WHEN p.status <> s.status THEN TIMESTAMP '2000-01-01 09:59:59' END, p.status = s.status, 1
    FROM src s JOIN {{f_projects}} p USING (project_id)""",
)
def scd2_projects(x):
    """Project dimension after statuses were derived anew from the tasks."""
    projects, tasks = x["f_projects"], x["f_tasks"]
    counts = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "todo").alias("todo")
    )
    base = projects.withColumnRenamed("name", "project_name")
    src = base.join(counts, "project_id", "left").withColumn(
        "status", F.when(F.col("todo") * 10 > F.col("n"), "active").otherwise(F.col("status"))
    )
    dim = scd2.first_version(base, None, scd2.PROJECTS, "1999-01-01 00:00:00", "B0")
    merged = scd2.scd2_merge(dim, src, scd2.PROJECTS, AS_OF, "B1")
    return merged.select(
        "project_id", "project_name", "status", "start_date", "effective_date", "expiry_date", "is_current", "version_number"
    )


_AS_OF_SQL = """
    WITH v AS (SELECT *, (SELECT min(n.effective_date) FROM {f_dim_users} n
                          WHERE n.user_id = d.user_id AND n.version_number = d.version_number + 1) AS valid_to
               FROM {f_dim_users} d)
    SELECT t.task_id, t.created_at, v.user_key AS assigned_to_key, v.role AS role_then
    FROM {f_tasks} t LEFT JOIN v ON t.assigned_to = v.user_id AND v.effective_date <= t.created_at
     AND CASE WHEN v.valid_to IS NOT NULL THEN t.created_at < v.valid_to
              ELSE v.expiry_date IS NULL OR t.created_at <= v.expiry_date END"""


@query("scd2_as_of", _AS_OF_SQL)
def scd2_as_of(x):
    """The assignee's version when each task was created."""
    take = {"assigned_to_key": "user_key", "role_then": "role"}
    found = lookup_as_of(x["f_tasks"], x["f_dim_users"], "assigned_to", "created_at", "user_id", take)
    return found.select("task_id", "created_at", "assigned_to_key", "role_then")


@query("scd2_as_of_merge", _AS_OF_SQL)
def scd2_as_of_merge(x):
    """The same by merging tasks and versions in time order."""
    take = {"assigned_to_key": "user_key", "role_then": "role"}
    found = lookup_as_of_merge(x["f_tasks"], x["f_dim_users"], "assigned_to", "created_at", "user_id", take)
    return found.select("task_id", "created_at", "assigned_to_key", "role_then")


@query(
    "scd2_problems",
    """
    WITH d AS (SELECT user_id, version_number, is_current FROM {f_dim_users}
               UNION ALL SELECT user_id, version_number + 2, TRUE FROM {f_dim_users} WHERE user_id % 50 = 7
               UNION ALL SELECT user_id, version_number + 1, FALSE FROM {f_dim_users} WHERE user_id % 50 = 9)
    SELECT user_id, count(*) AS versions, count(CASE WHEN is_current THEN 1 END) AS current_versions,
           count(DISTINCT version_number) <> count(*) OR max(version_number) - min(version_number) + 1 <> count(DISTINCT version_number) AS has_gap
    FROM d GROUP BY 1
    HAVING count(CASE WHEN is_current THEN 1 END) > 1
        OR count(DISTINCT version_number) <> count(*) OR max(version_number) - min(version_number) + 1 <> count(DISTINCT version_number)""",
)
def scd2_problems(x):
    """Damaged copies of the user dimension are found."""
    dim = x["f_dim_users"].select("user_id", "version_number", "is_current")
    second = dim.filter("user_id % 50 = 7").withColumns({"version_number": F.col("version_number") + 2, "is_current": F.lit(True)})
    extra = dim.filter("user_id % 50 = 9").withColumns({"version_number": F.col("version_number") + 1, "is_current": F.lit(False)})
    return scd2.scd2_problems(dim.unionByName(second).unionByName(extra), "user_id")


@query(
    "surrogate_keys",
    "SELECT row_number() OVER (ORDER BY organization_id, task_id) + 100 AS task_key, organization_id, task_id FROM {f_tasks}",
)
def surrogate_keys(x):
    """Dense keys in tenant order, continuing from 100."""
    return assign_keys(x["f_tasks"].select("organization_id", "task_id"), "task_key", ["organization_id", "task_id"], start=101)


@query(
    "dense_keys",
    """SELECT count(*) AS row_count, CAST(101 AS BIGINT) AS first_key, 100 + count(*) AS last_key, count(*) AS distinct_keys,
              CAST(sum(task_id) AS BIGINT) AS task_ids FROM {f_tasks}""",
)
def dense_keys(x):
    """Keys without an order: the rows are numbered where they are."""
    keyed = assign_keys(x["f_tasks"].select("organization_id", "task_id"), "task_key", start=101)
    return keyed.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("task_key").alias("first_key"), F.max("task_key").alias("last_key"),
        F.count_distinct("task_key").alias("distinct_keys"), F.sum("task_id").alias("task_ids"),
    )


# -- layout and maintenance -----------------------------------------------------------


@query("tenant_buckets", "SELECT organization_id, count(*) AS task_count, CAST(1 AS BIGINT) AS bucket_count FROM {f_tasks} GROUP BY 1")
def tenant_buckets(x):
    """Every tenant lies in one of four hash buckets."""
    rows = tables.hash_partition(x["f_tasks"], "organization_id", 4)
    per_bucket = rows.groupBy("organization_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return per_bucket.groupBy("organization_id").agg(
        F.sum("n").alias("task_count"), F.count_if(F.col("bucket").between(0, 3)).alias("bucket_count")
    )


@query("month_layout", "SELECT CAST(CAST(date_trunc('month', start_time) AS DATE) AS VARCHAR) AS month, count(*) AS log_count FROM {f_time_logs} GROUP BY 1")
def month_layout(x):
    return tables.month_partition(x["f_time_logs"], "start_time").groupBy("month").agg(F.count(F.lit(1)).alias("log_count"))


@query(
    "quarter_layout",
    """SELECT coalesce('tasks_' || year(due_date) || '_q' || quarter(due_date), 'tasks_no_date') AS part, count(*) AS task_count
       FROM {f_tasks} GROUP BY 1""",
)
def quarter_layout(x):
    return tables.quarter_partition(x["f_tasks"], "due_date").groupBy("part").agg(F.count(F.lit(1)).alias("task_count"))


@query(
    "partition_coverage",
    """
    WITH c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-06-01', TIMESTAMP '2002-05-01', INTERVAL 1 MONTH)) AS DATE) AS starts),
    h AS (SELECT CAST(date_trunc('month', start_time) AS DATE) AS starts, count(*) AS n FROM {f_time_logs} GROUP BY 1)
    SELECT CAST(starts AS VARCHAR) AS starts, 'time_logs_y' || strftime(starts, '%Ym%m') AS partition_name,
           CAST(CAST(starts + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS ends, coalesce(n, 0) AS row_count, n IS NULL AS is_missing
    FROM c LEFT JOIN h USING (starts)""",
)
def partition_coverage(x):
    calendar = tables.month_calendar(x.spark, "2001-06-15")
    return tables.partition_coverage(calendar, x["f_time_logs"], "start_time")


@query(
    "quarter_coverage",
    """
    WITH c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-10-01', INTERVAL 3 MONTH)) AS DATE) AS starts),
    h AS (SELECT CAST(date_trunc('quarter', due_date) AS DATE) AS starts, count(*) AS n FROM {f_tasks} GROUP BY 1)
    SELECT CAST(starts AS VARCHAR) AS starts, 'tasks_' || year(starts) || '_q' || quarter(starts) AS partition_name,
           CAST(CAST(starts + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS ends, coalesce(n, 0) AS row_count, n IS NULL AS is_missing
    FROM c LEFT JOIN h USING (starts)""",
)
def quarter_coverage(x):
    return tables.partition_coverage(tables.quarter_calendar(x.spark, AS_OF), x["f_tasks"], "due_date", "quarter")


@query(
    "retention",
    "SELECT task_id, user_id, start_time, billable FROM {f_time_logs} WHERE start_time >= TIMESTAMP '2000-12-02 00:00:00'",
)
def retention(x):
    return tables.retention(x["f_time_logs"], "start_time", 30, "2001-01-01").select("task_id", "user_id", "start_time", "billable")


@query(
    "column_defaults",
    """
    SELECT task_id, status, priority, 'to do' AS note, created_at AS updated_at, CAST(actual_hours AS DOUBLE) AS actual_hours
    FROM {f_tasks}""",
)
def column_defaults(x):
    """Defaults fill absent columns only."""
    rows = x["f_tasks"].select("task_id", "status", "priority", "created_at", "actual_hours")
    filled = tables.with_defaults(
        rows, {"status": F.lit("todo"), "note": F.lit("to do"), "updated_at": F.col("created_at"), "actual_hours": F.lit(0)}
    )
    return filled.drop("created_at")


@query(
    "generated_minutes",
    f"SELECT task_id, user_id, start_time, CAST({_MINUTES} AS INTEGER) AS duration_minutes FROM {{f_time_logs}}",
)
def generated_minutes(x):
    from workmill.functions.moments import minutes_between

    rows = tables.with_generated(
        x["f_time_logs"], {"duration_minutes": minutes_between(F.col("start_time"), F.col("end_time"))}
    )
    return rows.select("task_id", "user_id", "start_time", "duration_minutes")


_PROFILED = ["task_id", "project_id", "status", "priority", "assigned_to", "title"]


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {{f_tasks}}"
        for c in _PROFILED
    ),
)
def table_profile(x):
    return tables.table_profile(x["f_tasks"].select(*_PROFILED), exact=True)
