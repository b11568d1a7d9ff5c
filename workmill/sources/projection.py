"""Work-tracking tables projected from generic order/event tables.

The SQL uses only what ANSI-minded engines share, so the same text defines the
input on Spark and in an oracle. `{name}` marks a base table or another
projection.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "f_users": """
SELECT c_custkey AS user_id, n_regionkey AS organization_id,
       c_name AS username, lower(c_name) || '@example.com' AS email,
       'Customer' AS first_name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE substr(c_name, 10) END AS last_name,
       CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'member' ELSE 'guest' END AS role,
       CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_custkey % 10 = 3 THEN 'pending' ELSE 'active' END AS status,
       c_mktsegment AS department,
       CASE WHEN c_custkey >= 10 THEN CAST(floor(c_custkey / 10) AS BIGINT) END AS manager_id,
       DATE '1990-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS hire_date,
       CAST(DATE '1999-01-01' + CAST(c_custkey % 365 AS INTEGER) AS {timestamp}) AS last_login_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "f_projects": """
SELECT n_nationkey AS project_id, n_regionkey AS organization_id, n_name AS name,
       CASE n_nationkey % 5 WHEN 0 THEN 'planning' WHEN 1 THEN 'active' WHEN 2 THEN 'on_hold'
                            WHEN 3 THEN 'completed' ELSE 'cancelled' END AS status,
       CAST(n_nationkey * 1000 AS DECIMAL(12,2)) AS budget,
       DATE '1995-01-01' + n_nationkey AS start_date,
       CASE WHEN n_nationkey % 7 = 6 THEN {ts} '1999-06-01 00:00:00' END AS deleted_at
FROM {nation}""",
    "f_tasks": """
SELECT o_orderkey AS task_id, n_regionkey AS organization_id,
       CASE WHEN o_orderkey % 17 = 16 THEN NULL ELSE n_nationkey END AS project_id,
       CASE WHEN o_orderkey >= 10 THEN CAST(floor(o_orderkey / 10) AS BIGINT) END AS parent_task_id,
       'TSK-' || CAST(o_orderkey AS STRING) AS task_sk,
       'Task ' || CAST(o_orderkey AS STRING) AS title,
       CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'in_progress'
            WHEN o_orderkey % 3 = 0 THEN 'todo' WHEN o_orderkey % 3 = 1 THEN 'in_review' ELSE 'backlog' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 10 = 9 THEN NULL
            ELSE o_orderdate + INTERVAL '60' DAY + INTERVAL '15' HOUR END AS due_date,
       o_orderdate + INTERVAL '5' DAY + INTERVAL '11' HOUR AS status_changed_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '45' DAY + INTERVAL '9' HOUR END AS completed_at,
       CASE WHEN o_orderkey % 20 = 0 THEN CAST(0 AS DECIMAL(10,2))
            ELSE CAST(floor(o_totalprice / 1000) AS DECIMAL(10,2)) END AS estimated_hours,
       CAST(o_orderkey % 400 AS DECIMAL(10,2)) AS actual_hours,
       CAST(o_orderkey % 8 AS DECIMAL(5,2)) AS story_points,
       o_orderkey % 11 = 0 AS is_blocked,
       CASE WHEN o_orderkey % 19 = 18 THEN NULL ELSE o_custkey END AS assigned_to,
       o_orderkey % 150 AS reporter_id
FROM {orders} JOIN {nation} ON o_orderkey % 25 = n_nationkey""",
    "f_time_logs": """
SELECT l_orderkey AS task_id, o_custkey AS user_id, n_regionkey AS organization_id,
       l_shipdate + INTERVAL '8' HOUR AS start_time,
       CASE WHEN l_linenumber = 7 THEN NULL
            ELSE l_shipdate + INTERVAL '8' HOUR + INTERVAL '6' MINUTE * CAST(l_quantity AS INTEGER)
                 + INTERVAL '45' SECOND END AS end_time,
       l_returnflag = 'R' AS billable,
       CAST(50 + l_suppkey % 50 AS DECIMAL(10,2)) AS hourly_rate
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {nation} ON o_orderkey % 25 = n_nationkey""",
    "f_batches": """
SELECT 'B' || CAST(event_id AS STRING) AS batch_id, ts AS batch_start_time,
       CASE WHEN event_type = 'view' THEN NULL
            ELSE ts + INTERVAL '1' SECOND * CAST(user_id * 10 AS INTEGER) END AS batch_end_time,
       CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
       'S' || CAST(user_id % 10 AS STRING) AS source_system,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS records_processed
FROM {events}""",
    "f_audit": """
SELECT event_id AS log_id, user_id,
       CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'
                       WHEN 'click' THEN 'LOGIN' ELSE 'LOGOUT' END AS action,
       CASE WHEN event_id % 2 = 0 THEN 'task' ELSE 'project' END AS entity_type,
       event_id % 50 AS entity_id, props AS new_values, ts AS created_at
FROM {events}""",
    "f_notifications": """
SELECT event_id AS notification_id, user_id, event_type AS type,
       event_type <> 'view' AS is_read, ts AS created_at, ts + INTERVAL '1' HOUR AS scheduled_for
FROM {events}""",
    "f_comments": """
SELECT event_id AS comment_id, event_id % 1500 AS task_id, user_id,
       CASE WHEN event_id >= 5 THEN CAST(floor(event_id / 5) AS BIGINT) END AS parent_comment_id,
       ts AS created_at,
       CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL '1' DAY END AS deleted_at
FROM {events}""",
    "f_task_status": """
SELECT * FROM (VALUES (1,'backlog','Backlog','open'), (2,'todo','To do','open'),
  (3,'in_progress','In progress','active'), (4,'in_review','In review','active'),
  (5,'done','Done','closed')) AS v(status_key, status_id, status_name, status_category)""",
    "f_priority": """
SELECT * FROM (VALUES (1,'critical','Critical',1), (2,'high','High',2),
  (3,'medium','Medium',3), (4,'low','Low',4)) AS v(priority_key, priority_id, priority_name, priority_level)""",
    # Dimensions the fact loads look keys up in: the current version of each.
    "f_cur_users": "SELECT CAST(user_id + 1 AS INTEGER) AS user_key, user_id, TRUE AS is_current FROM {f_users}",
    "f_cur_projects": "SELECT CAST(project_id + 1 AS INTEGER) AS project_key, project_id, TRUE AS is_current FROM {f_projects}",
    "f_cur_status": "SELECT status_key, status_id, TRUE AS is_current FROM {f_task_status}",
    "f_cur_priority": "SELECT priority_key, priority_id, TRUE AS is_current FROM {f_priority}",
    # A stored user dimension and the source of the next load. Users divisible
    # by 10 are unknown so far, except those divisible by 20, which were
    # deleted in 1998; those divisible by 11 have one older version.
    "f_dim_users": """
SELECT CAST(user_id + 1 AS INTEGER) AS user_key, user_id, organization_id, username, email, first_name, last_name,
       role, status, department, manager_id, hire_date,
       {ts} '1999-01-01 00:00:00' AS effective_date, CAST(NULL AS {timestamp}) AS expiry_date, TRUE AS is_current,
       CASE WHEN user_id % 11 = 0 THEN 2 ELSE 1 END AS version_number,
       'OLTP' AS source_system, 'B0' AS etl_batch_id, {ts} '1999-01-01 00:00:00' AS etl_timestamp
FROM {f_users} WHERE user_id % 10 <> 0
UNION ALL
SELECT CAST(1000000 + user_id AS INTEGER), user_id, organization_id, username, email, first_name, last_name,
       'guest', status, department, manager_id, hire_date,
       {ts} '1998-01-01 00:00:00', {ts} '1998-12-31 23:59:59', FALSE, 1, 'OLTP', 'B0', {ts} '1999-01-01 00:00:00'
FROM {f_users} WHERE user_id % 10 <> 0 AND user_id % 11 = 0
UNION ALL
SELECT CAST(2000000 + user_id AS INTEGER), user_id, organization_id, username, email, first_name, last_name,
       role, status, department, manager_id, hire_date,
       {ts} '1998-01-01 00:00:00', {ts} '1998-06-30 00:00:00', FALSE, 1, 'OLTP', 'B0', {ts} '1998-06-30 00:00:01'
FROM {f_users} WHERE user_id % 20 = 0""",
    "f_src_users": """
SELECT user_id, organization_id, username, email, first_name, last_name,
       CASE WHEN user_id % 7 = 0 THEN 'member' ELSE role END AS role, status,
       CASE WHEN user_id % 6 = 0 THEN 'MOVED' ELSE department END AS department, manager_id, hire_date
FROM {f_users} WHERE user_id % 13 <> 0""",
    "f_src_tasks": """
SELECT task_id, organization_id, project_id, parent_task_id, task_sk, title, status,
       CASE WHEN task_id % 8 = 0 THEN 'low' ELSE priority END AS priority,
       created_at, due_date, status_changed_at, completed_at, estimated_hours, actual_hours, story_points,
       is_blocked, assigned_to, reporter_id
FROM {f_tasks}""",
    "f_old_tasks": "SELECT * FROM {f_tasks} WHERE task_id % 9 <> 0",
    "f_assignments": """
SELECT DISTINCT l_orderkey AS task_id, l_suppkey AS user_id, o_orderdate + INTERVAL '1' DAY AS assigned_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION
SELECT task_id, assigned_to, created_at + INTERVAL '1' DAY FROM {f_tasks} WHERE assigned_to IS NOT NULL""",
    "f_tags": "SELECT DISTINCT p_type AS tag_id, lower(p_type) AS name FROM {part}",
    "f_task_tags": "SELECT DISTINCT l_orderkey AS task_id, p_type AS tag_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "f_sessions": """
SELECT event_id AS session_id, user_id, sha2_hex('T' || CAST(event_id % 4000 AS STRING)) AS token_hash,
       ts + INTERVAL '10' DAY AS expires_at, event_id % 7 = 0 AS is_revoked
FROM {events} WHERE event_type = 'signup' OR event_type = 'click'""",
    "f_locks": """
SELECT event_id AS request_id, user_id AS pid, event_type AS locktype,
       CASE WHEN event_id % 40 = 39 THEN NULL ELSE event_id % 40 END AS relation, event_id % 3 <> 0 AS granted
FROM {events}""",
    "f_docs": """
SELECT doc_id, source, n_chars, regexp_extract(text, '^([^\\n]*)', 1) AS title,
       substr(text, length(regexp_extract(text, '^([^\\n]*)', 1)) + 1) AS body
FROM {documents}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def oracle(query: str) -> str:
    """A DuckDB query with the projections it names as leading CTEs."""
    ctes: dict[str, str] = {}

    def dialect(text: str) -> str:
        text = text.replace("{timestamp}", "TIMESTAMP").replace("{ts}", "TIMESTAMP").replace("sha2_hex(", "sha256(")
        for name in _NAME.findall(text):
            add(name)
        return _NAME.sub(r"\1", text)

    def add(name: str) -> None:
        if name in VIEWS and name not in ctes:
            body = dialect(VIEWS[name])
            ctes[name] = f"{name} AS ({body.strip()})"

    body = dialect(query).strip()
    if not ctes:
        return body
    head = ",\n".join(ctes.values())
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    if body.upper().startswith("WITH "):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {recursive}{head},\n{rest}"
    return f"WITH {recursive}{head}\n{body}"


class Inputs:
    """The projections over one folder of base tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._sql(VIEWS[name]) if name in VIEWS else self.base(name)
        return self._made[name]

    def _sql(self, text: str) -> DataFrame:
        text = text.replace("{timestamp}", "TIMESTAMP_NTZ").replace("{ts}", "TIMESTAMP_NTZ")
        text = re.sub(r"sha2_hex\(([^()]*\([^()]*\)[^()]*)\)", r"sha2(\1, 256)", text)
        # Spark reads a backslash in a literal as an escape, the oracle does not.
        text = text.replace("\\n", "\\\\n") if "regexp_extract" in text else text
        return self.spark.sql(text, **{n: self[n] for n in set(_NAME.findall(text))})

    @cached_property
    def dims(self):
        from workmill.operators.calendar import dim_time
        from workmill.operators.facts import Dims

        return Dims(
            self["f_cur_users"],
            self["f_cur_projects"],
            self["f_cur_status"],
            self["f_cur_priority"],
            dim_time(self.spark, "1995-01-01", "2002-12-31"),
        )
