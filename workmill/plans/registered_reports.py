"""Queries over the source model: reports, hierarchy, search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workmill.operators.hierarchy import forest, subtree_counts
from workmill.operators.inverted import WordIndex
from workmill.operators.search import STOP_WORDS, build_index, search, search_index
from workmill.plans import reports
from workmill.plans.registry import AS_OF, EVENTS_AS_OF, dec, query
from workmill.session import shared_folder

NOW = "TIMESTAMP '2000-01-01 10:00:00'"
MIDNIGHT = "TIMESTAMP '2000-01-01 00:00:00'"
_SECONDS = "(epoch_us(end_time) - epoch_us(start_time)) / 1000000.0"
_MINUTES = f"CAST(round({_SECONDS}) AS BIGINT) // 60"

# -- summary views ----------------------------------------------------------------


@query(
    "task_metrics",
    f"""
    SELECT t.organization_id, t.project_id, p.name AS project_name,
           count(CASE t.status WHEN 'todo' THEN 1 END) AS todo_count,
           count(CASE t.status WHEN 'in_progress' THEN 1 END) AS in_progress_count,
           count(CASE t.status WHEN 'in_review' THEN 1 END) AS in_review_count,
           count(CASE t.status WHEN 'done' THEN 1 END) AS done_count,
           count(CASE WHEN t.due_date < {MIDNIGHT} AND t.status <> 'done' THEN 1 END) AS overdue_count,
           {dec('sum(coalesce(t.estimated_hours, 0))')} AS total_estimated_hours,
           {dec('sum(coalesce(t.actual_hours, 0))')} AS total_actual_hours
    FROM {{f_tasks}} t LEFT JOIN {{f_projects}} p ON t.project_id = p.project_id GROUP BY 1, 2, 3""",
)
def task_metrics(x):
    return reports.task_metrics(x["f_tasks"], x["f_projects"], AS_OF)


# The literal product is computed here and only here.
_COUNTS = f"""count(DISTINCT t.task_id) AS total_tasks,
           count(DISTINCT CASE WHEN t.status <> 'done' THEN t.task_id END) AS active_tasks,
           count(DISTINCT CASE WHEN t.due_date < {MIDNIGHT} AND t.status <> 'done' THEN t.task_id END) AS overdue_tasks"""


@query(
    "user_workload",
    f"""
    SELECT u.organization_id, u.user_id, u.email, u.first_name, u.last_name, {_COUNTS},
           {dec('sum(coalesce(t.estimated_hours, 0))')} AS total_estimated_hours,
           {dec(f'sum(coalesce({_MINUTES}, 0))::DOUBLE / 60', 4)} AS total_logged_hours
    FROM {{f_users}} u LEFT JOIN {{f_tasks}} t ON u.user_id = t.assigned_to
    LEFT JOIN {{f_time_logs}} l ON u.user_id = l.user_id GROUP BY 1, 2, 3, 4, 5""",
)
def user_workload(x):
    return reports.user_workload(x["f_users"], x["f_tasks"], x["f_time_logs"], AS_OF)


@query(
    "user_workload_exact",
    f"""
    SELECT u.organization_id, u.user_id, u.email, u.first_name, u.last_name,
           coalesce(n.total_tasks, 0) AS total_tasks, coalesce(n.active_tasks, 0) AS active_tasks,
           coalesce(n.overdue_tasks, 0) AS overdue_tasks, {dec('coalesce(n.hours, 0)')} AS total_estimated_hours,
           {dec('coalesce(m.minutes, 0)::DOUBLE / 60', 4)} AS total_logged_hours
    FROM {{f_users}} u
    LEFT JOIN (SELECT t.assigned_to, {_COUNTS}, sum(t.estimated_hours) AS hours FROM {{f_tasks}} t GROUP BY 1) n ON n.assigned_to = u.user_id
    LEFT JOIN (SELECT user_id, sum({_MINUTES}) AS minutes FROM {{f_time_logs}} GROUP BY 1) m ON m.user_id = u.user_id""",
)
def user_workload_exact(x):
    return reports.user_workload(x["f_users"], x["f_tasks"], x["f_time_logs"], AS_OF, exact=True, unique_tasks=True)


# -- task lists -----------------------------------------------------------------------


@query(
    "overdue_by_user",
    f"""SELECT assigned_to, task_id, title, status, due_date FROM {{f_tasks}}
        WHERE assigned_to IS NOT NULL AND status NOT IN ('done', 'cancelled') AND due_date < {NOW}""",
)
def overdue_by_user(x):
    return reports.overdue_tasks(x["f_tasks"], AS_OF).select("assigned_to", "task_id", "title", "status", "due_date")


@query("user_tasks", "SELECT assigned_to, status, due_date, task_id, priority FROM {f_tasks} WHERE assigned_to IS NOT NULL")
def user_tasks(x):
    return reports.tasks_of_user(x["f_tasks"]).select("assigned_to", "status", "due_date", "task_id", "priority")


@query("project_tasks", "SELECT project_id, status, priority, due_date, task_id FROM {f_tasks} WHERE project_id IS NOT NULL")
def project_tasks(x):
    return reports.project_tasks(x["f_tasks"]).select("project_id", "status", "priority", "due_date", "task_id")


@query("child_tasks", "SELECT parent_task_id, organization_id, task_id, status FROM {f_tasks} WHERE parent_task_id IS NOT NULL")
def child_tasks(x):
    return reports.child_tasks(x["f_tasks"]).select("parent_task_id", "organization_id", "task_id", "status")


@query(
    "dashboard",
    """SELECT organization_id, status, priority, CAST(CAST(due_date AS DATE) AS VARCHAR) AS due_day, count(*) AS task_count
       FROM {f_tasks} WHERE status <> 'done' GROUP BY 1, 2, 3, 4""",
)
def dashboard(x):
    return reports.dashboard(x["f_tasks"])


@query("open_past_due", f"SELECT task_id, status, due_date FROM {{f_tasks}} WHERE status = 'todo' AND due_date < {NOW}")
def open_past_due(x):
    return reports.open_past_due(x["f_tasks"], AS_OF, "todo").select("task_id", "status", "due_date")


# -- time and completion ------------------------------------------------------------


@query(
    "hours_by_project",
    f"""
    SELECT p.name AS project_name, {dec(f'sum((epoch_us(l.end_time) - epoch_us(l.start_time)) // 1000000)::DOUBLE / 3600', 4)} AS hours_logged
    FROM {{f_time_logs}} l JOIN {{f_tasks}} t ON l.task_id = t.task_id JOIN {{f_projects}} p ON t.project_id = p.project_id
    WHERE l.end_time IS NOT NULL GROUP BY 1""",
)
def hours_by_project(x):
    return reports.hours_by_project(x["f_time_logs"], x["f_tasks"], x["f_projects"])


@query(
    "time_by_day",
    f"""SELECT user_id, CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, count(*) AS log_count, CAST(sum({_MINUTES}) AS BIGINT) AS total_minutes
        FROM {{f_time_logs}} WHERE end_time IS NOT NULL GROUP BY 1, 2""",
)
def time_by_day(x):
    return reports.time_by_user_day(x["f_time_logs"])


@query(
    "billable_month",
    f"""SELECT organization_id, CAST(CAST(date_trunc('month', start_time) AS DATE) AS VARCHAR) AS month, count(*) AS log_count,
               CAST(coalesce(sum({_MINUTES}), 0) AS BIGINT) AS total_minutes
        FROM {{f_time_logs}} WHERE billable GROUP BY 1, 2""",
)
def billable_month(x):
    return reports.billable_by_month(x["f_time_logs"])


@query(
    "time_by_org_day",
    f"""SELECT organization_id, CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, billable, count(*) AS log_count,
               CAST(sum({_MINUTES}) AS BIGINT) AS total_minutes
        FROM {{f_time_logs}} WHERE end_time IS NOT NULL GROUP BY 1, 2, 3""",
)
def time_by_org_day(x):
    return reports.time_by_org_day(x["f_time_logs"])


@query(
    "completion_by_day",
    f"""SELECT organization_id, CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, count(*) AS completed_count,
               {dec('sum(coalesce(actual_hours, 0))')} AS actual_hours
        FROM {{f_tasks}} WHERE status = 'done' GROUP BY 1, 2""",
)
def completion_by_day(x):
    return reports.completion_by_day(x["f_tasks"])


@query(
    "due_quarter",
    """SELECT organization_id, CAST(quarter(due_date) AS INTEGER) AS due_quarter, CAST(year(due_date) AS INTEGER) AS due_year,
              count(*) AS task_count FROM {f_tasks} WHERE due_date IS NOT NULL GROUP BY 1, 2, 3""",
)
def due_quarter(x):
    return reports.due_by_quarter(x["f_tasks"])


# -- other access paths -------------------------------------------------------------


@query("unread", "SELECT user_id, created_at, notification_id, type FROM {f_notifications} WHERE NOT is_read")
def unread(x):
    return reports.unread_notifications(x["f_notifications"]).select("user_id", "created_at", "notification_id", "type")


@query(
    "due_notifications",
    """SELECT notification_id, user_id, scheduled_for FROM {f_notifications}
       WHERE NOT is_read AND scheduled_for <= TIMESTAMP '2024-01-15 12:00:00'""",
)
def due_notifications(x):
    rows = reports.due_notifications(x["f_notifications"], "2024-01-15 12:00:00")
    return rows.select("notification_id", "user_id", "scheduled_for")


@query("audit_trail", "SELECT log_id, user_id, action, entity_id, created_at FROM {f_audit} WHERE entity_type = 'task'")
def audit_trail(x):
    return reports.audit_trail(x["f_audit"], "task").select("log_id", "user_id", "action", "entity_id", "created_at")


@query(
    "active_projects",
    """SELECT p.organization_id, p.project_id, p.name, count(t.task_id) AS task_count
       FROM {f_projects} p LEFT JOIN {f_tasks} t ON t.project_id = p.project_id
       WHERE p.status = 'active' AND p.deleted_at IS NULL GROUP BY 1, 2, 3""",
)
def active_projects(x):
    counts = x["f_tasks"].groupBy("project_id").agg(F.count(F.lit(1)).alias("task_count"))
    rows = reports.active_projects(x["f_projects"]).join(counts, "project_id", "left")
    return rows.select("organization_id", "project_id", "name", F.coalesce("task_count", F.lit(0)).alias("task_count"))


@query("recent_comments", "SELECT task_id, comment_id, user_id, created_at FROM {f_comments} WHERE deleted_at IS NULL")
def recent_comments(x):
    return reports.recent_comments(x["f_comments"]).select("task_id", "comment_id", "user_id", "created_at")


@query("recent_users", "SELECT user_id, organization_id, last_login_at FROM {f_users} WHERE status = 'active'")
def recent_users(x):
    return reports.recent_users(x["f_users"]).select("user_id", "organization_id", "last_login_at")


@query("users_by_status", "SELECT organization_id, status, count(*) AS user_count FROM {f_users} GROUP BY 1, 2")
def users_by_status(x):
    return reports.users_by_status(x["f_users"])


@query("email_lookup", "SELECT user_id, email FROM {f_users} WHERE lower(email) = lower('CUSTOMER#000000042@Example.com')")
def email_lookup(x):
    return reports.find_email(x["f_users"], "CUSTOMER#000000042@Example.com").select("user_id", "email")


@query(
    "tasks_by_tag",
    """SELECT g.tag_id, g.name AS tag_name, count(t.task_id) AS task_count, count(CASE WHEN t.status <> 'done' THEN 1 END) AS open_count
       FROM {f_tags} g LEFT JOIN {f_task_tags} tt ON tt.tag_id = g.tag_id LEFT JOIN {f_tasks} t ON t.task_id = tt.task_id GROUP BY 1, 2""",
)
def tasks_by_tag(x):
    return reports.tasks_by_tag(x["f_tasks"], x["f_task_tags"], x["f_tags"])


# -- batch log -------------------------------------------------------------------------

_TOOK = "(epoch_us(batch_end_time) - epoch_us(batch_start_time)) / 1000000.0"


@query(
    "latest_batch",
    f"""SELECT batch_id, batch_start_time, batch_end_time, status, {dec(_TOOK)} AS duration_seconds, records_processed
        FROM {{f_batches}} ORDER BY batch_start_time DESC, batch_id DESC LIMIT 1""",
)
def latest_batch(x):
    return reports.latest_batch(x["f_batches"])


@query(
    "batch_status",
    f"""SELECT batch_id, batch_start_time, batch_end_time, status, {dec(_TOOK + ' / 60', 6)} AS duration_minutes, records_processed
        FROM {{f_batches}} WHERE batch_start_time >= TIMESTAMP '2024-01-29 00:00:00'""",
)
def batch_status(x):
    rows = reports.batch_status(x["f_batches"], EVENTS_AS_OF, 48)
    return rows.withColumn("duration_minutes", F.col("duration_minutes").cast("decimal(20,6)"))


# -- hierarchy ----------------------------------------------------------------------------

_TREE = """
    WITH RECURSIVE tree AS (
      SELECT task_id AS root_id, task_id, 0 AS depth, status FROM {f_tasks} WHERE parent_task_id IS NULL
      UNION ALL
      SELECT tree.root_id, t.task_id, tree.depth + 1, t.status FROM {f_tasks} t JOIN tree ON t.parent_task_id = tree.task_id)"""


@query("task_tree", _TREE + " SELECT root_id, task_id, CAST(depth AS INTEGER) AS depth, status FROM tree")
def task_tree(x):
    return forest(x["f_tasks"], "task_id", "parent_task_id", ["status"])


@query(
    "task_tree_counts",
    _TREE + " SELECT root_id, count(*) AS node_count, CAST(max(depth) AS INTEGER) AS max_depth FROM tree GROUP BY 1",
)
def task_tree_counts(x):
    return subtree_counts(forest(x["f_tasks"], "task_id", "parent_task_id"))


@query(
    "comment_threads",
    """
    WITH RECURSIVE tree AS (
      SELECT comment_id AS root_id, comment_id, 0 AS depth FROM {f_comments} WHERE parent_comment_id IS NULL
      UNION ALL
      SELECT tree.root_id, c.comment_id, tree.depth + 1 FROM {f_comments} c JOIN tree ON c.parent_comment_id = tree.comment_id)
    SELECT root_id, comment_id, CAST(depth AS INTEGER) AS depth FROM tree""",
)
def comment_threads(x):
    return forest(x["f_comments"], "comment_id", "parent_comment_id")


# -- search ----------------------------------------------------------------------------------

_GAP = r"'[^\p{L}\p{N}]+', ' ', 'g'"
_SPACED = f"""
    WITH s AS (SELECT doc_id, ' ' || regexp_replace(lower(title), {_GAP}) || ' ' AS a,
                      ' ' || regexp_replace(lower(body), {_GAP}) || ' ' AS b FROM {{f_docs}}),
    d AS (SELECT doc_id, a, b, regexp_replace(a || b, ' +', ' ', 'g') AS w FROM s)"""


def _rank(*words: str) -> str:
    def hits(part: str) -> str:
        inside = ", ".join(f"'{w}'" for w in words)
        return f"len(list_filter(string_split({part}, ' '), lambda w: w IN ({inside})))"

    return dec(f"({hits('a')} * 10 + {hits('b')} * 4) / 10.0", 1)


def _docs(x):
    return x["f_docs"], "doc_id", F.col("title"), F.col("body")


def _search(x, text: str):
    docs, key, title, body = _docs(x)
    return search(docs, text, key, title, body)


@query(
    "search_words",
    _SPACED + f" SELECT doc_id, {_rank('license', 'released')} AS rank FROM d WHERE contains(w, ' license ') AND contains(w, ' released ')",
)
def search_words(x):
    return _search(x, "License RELEASED")


@query(
    "search_phrase",
    _SPACED + f" SELECT doc_id, {_rank('licensed', 'apache')} AS rank FROM d WHERE regexp_matches(w, ' licensed [^ ]+ [^ ]+ apache ')",
)
def search_phrase(x):
    """'under the' are stop words: any two words may stand between."""
    return _search(x, '"licensed under the Apache"')


@query(
    "search_not",
    _SPACED + f" SELECT doc_id, {_rank('license')} AS rank FROM d WHERE contains(w, ' license ') AND NOT contains(w, ' released ')",
)
def search_not(x):
    return _search(x, "license -released")


@query(
    "search_or",
    _SPACED
    + f""" SELECT doc_id, {_rank('thing', 'gnu', 'license')} AS rank FROM d
    WHERE contains(w, ' thing ') OR (contains(w, ' gnu ') AND contains(w, ' license '))""",
)
def search_or(x):
    return _search(x, "thing or GNU license")


@query(
    "search_index",
    _SPACED + f" SELECT doc_id, {_rank('license', 'released')} AS rank FROM d WHERE contains(w, ' license ') AND contains(w, ' released ')",
)
def search_index_query(x):
    """The same search answered from the word index."""
    docs, key, title, body = _docs(x)
    return search_index(build_index(docs, key, title, body), "license released", key)


def _stored_index(x) -> WordIndex:
    docs, key, title, body = _docs(x)
    index = WordIndex(x.spark, f"{shared_folder(x.spark)}/{x.spark.sparkContext.applicationId}/{uuid.uuid4()}", key, width=256)
    index.build(docs, title, body)
    return index


@query(
    "search_stored",
    _SPACED
    + f""" SELECT doc_id, {_rank('license', 'thing', 'licensed', 'apache')} AS rank FROM d
    WHERE (contains(w, ' license ') AND NOT contains(w, ' released ')) OR (contains(w, ' thing ') AND regexp_matches(w, ' licensed [^ ]+ [^ ]+ apache '))""",
)
def search_stored(x):
    """Words, a phrase, an alternative and a barred word in a written index."""
    return _stored_index(x).search('license -released or thing "licensed under the Apache"')


@query("search_without", _SPACED + " SELECT doc_id, CAST(0 AS DOUBLE) AS rank FROM d WHERE NOT contains(w, ' license ')")
def search_without(x):
    """Documents without a word: only the list of documents names them."""
    return _stored_index(x).search("-license")


@query(
    "text_index",
    _SPACED
    + """, t AS (SELECT doc_id, unnest(list_filter(string_split(a, ' '), lambda w: w <> '')) AS token, 'A' AS weight FROM d
                UNION ALL SELECT doc_id, unnest(list_filter(string_split(b, ' '), lambda w: w <> '')), 'B' FROM d)
    SELECT token, weight, count(*) AS word_count, count(DISTINCT doc_id) AS doc_count FROM t
    WHERE token NOT IN ("""
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + ") GROUP BY 1, 2",
)
def text_index(x):
    """Word and document counts of every word, read from a written index."""
    return _stored_index(x).counts()
