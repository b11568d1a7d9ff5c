"""Queries over logs, checks and governance."""

from __future__ import annotations


from pyspark.sql import functions as F

from workmill.functions.crypto import decrypt_cols, encrypt_cols, hash_on_change
from workmill.functions.scalars import json_object
from workmill.operators import facts, governance, oplog, opmetrics, quality
from workmill.plans.registry import EVENTS_AS_OF, dec, half_up, query
from workmill.session import shared_folder
from workmill.sources.schemas import VOCABULARY

# -- load logs ---------------------------------------------------------------------


@query(
    "batch_fold",
    """SELECT batch_id, batch_start_time, batch_end_time, status, source_system,
              CASE WHEN batch_end_time IS NULL THEN 0 ELSE records_processed END AS records_processed,
              CASE WHEN status = 'FAILED' THEN 'failed' END AS error_message
       FROM {f_batches}""",
)
def batch_fold(x):
    """Start and end rows of every batch folded back into one."""
    b = x["f_batches"]
    none = F.lit(None)
    start = b.select(
        "batch_id",
        "batch_start_time",
        none.cast("timestamp_ntz").alias("batch_end_time"),
        F.lit("RUNNING").alias("status"),
        "source_system",
        F.lit(0).alias("records_processed"),
        F.lit("not finished").alias("error_message"),
    )
    start = start.withColumn("error_message", F.when(F.col("status") != "RUNNING", F.col("error_message")))
    end = b.filter(F.col("batch_end_time").isNotNull()).select(
        "batch_id",
        none.cast("timestamp_ntz").alias("batch_start_time"),
        "batch_end_time",
        "status",
        none.cast("string").alias("source_system"),
        "records_processed",
        F.when(F.col("status") == "FAILED", "failed").alias("error_message"),
    )
    return oplog.fold_batches(start.unionByName(end))


_TOOK = "(epoch_us(batch_end_time) - epoch_us(batch_start_time)) / 1000000.0"


@query(
    "audit_log_rows",
    f"""SELECT batch_id, source_system AS table_name, 'LOAD' AS operation_type, records_processed AS records_affected,
               batch_start_time AS start_time, coalesce(batch_end_time, TIMESTAMP '2024-01-31 00:00:00') AS end_time, status,
               {dec(_TOOK)} AS execution_time_seconds
        FROM {{f_batches}}""",
)
def audit_log_rows(x):
    runs = x["f_batches"].select(
        "batch_id",
        F.col("source_system").alias("table_name"),
        F.lit("LOAD").alias("operation_type"),
        F.col("records_processed").alias("records_affected"),
        F.col("batch_start_time").alias("start_time"),
        F.col("batch_end_time").alias("end_time"),
        "status",
    )
    return oplog.audit_rows(runs, F.expr(f"TIMESTAMP_NTZ '{EVENTS_AS_OF}'"))


@query(
    "error_batches",
    """SELECT batch_id, 'ERROR' AS error_severity, source_system AS source_table, batch_end_time AS error_timestamp
       FROM {f_batches} WHERE status = 'FAILED'""",
)
def error_batches(x):
    failed = oplog.fold_batches(x["f_batches"].withColumn("error_message", F.lit(None).cast("string"))).filter(
        F.col("status") == "FAILED"
    )
    return failed.select(
        "batch_id",
        F.lit("ERROR").alias("error_severity"),
        F.col("source_system").alias("source_table"),
        F.col("batch_end_time").alias("error_timestamp"),
    )


@query(
    "batch_ids",
    """SELECT batch_id, 'BATCH-' || strftime(batch_start_time, '%Y%m%d-%H%M%S') || '-' || substr(md5(batch_id), 1, 8) AS generated_id
       FROM {f_batches}""",
)
def batch_ids(x):
    return x["f_batches"].select(
        "batch_id", oplog.batch_id_column(F.col("batch_start_time"), F.col("batch_id")).alias("generated_id")
    )


# -- tenants, roles, sessions, secrets ----------------------------------------------------


@query(
    "tenant_scope",
    """SELECT 'tasks' AS table_name, count(*) AS row_count FROM {f_tasks} WHERE organization_id = 3
       UNION ALL SELECT 'users', count(*) FROM {f_users} WHERE organization_id = 3
       UNION ALL SELECT 'time_logs', count(*) FROM {f_time_logs} WHERE organization_id = 3
       UNION ALL SELECT 'task_tags', 0""",
)
def tenant_scope(x):
    """What one tenant sees; a table without a policy shows nothing."""
    scope = governance.TenantScope(3)
    out = None
    for name in ("tasks", "users", "time_logs", "task_tags"):
        rows = scope.apply(name, x[f"f_{name}"]).agg(F.count(F.lit(1)).alias("row_count"))
        rows = rows.select(F.lit(name).alias("table_name"), "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "permissions",
    """WITH r AS (SELECT task_id, assigned_to + task_id % 3 AS user_id,
                         CASE task_id % 4 WHEN 0 THEN 'view_reports' WHEN 1 THEN 'manage_tasks' WHEN 2 THEN 'view_tasks' ELSE 'drop_all' END AS permission
                  FROM {f_tasks})
       SELECT r.task_id, r.user_id, r.permission,
              coalesce(u.role = 'admin' OR (u.role = 'manager' AND r.permission IN ('view_reports', 'manage_tasks'))
                       OR (u.role = 'member' AND r.permission = 'view_tasks'), FALSE) AS allowed
       FROM r LEFT JOIN {f_users} u ON u.user_id = r.user_id""",
)
def permissions(x):
    wanted = F.expr("CASE task_id % 4 WHEN 0 THEN 'view_reports' WHEN 1 THEN 'manage_tasks' WHEN 2 THEN 'view_tasks' ELSE 'drop_all' END")
    requests = x["f_tasks"].select(
        "task_id", (F.col("assigned_to") + F.col("task_id") % 3).alias("user_id"), wanted.alias("permission")
    )
    return governance.permissions(requests, x["f_users"])


@query(
    "session_valid",
    """WITH p AS (SELECT event_id AS request_id, 'T' || CAST(event_id % 5000 AS VARCHAR) AS token FROM events),
       live AS (SELECT token_hash, session_id, user_id, row_number() OVER (PARTITION BY token_hash ORDER BY expires_at DESC, session_id DESC) AS rn
                FROM {f_sessions} WHERE expires_at > TIMESTAMP '2024-01-31 00:00:00' AND NOT is_revoked)
       SELECT p.request_id, p.token, live.session_id IS NOT NULL AS is_valid, live.user_id, live.session_id
       FROM p LEFT JOIN live ON live.token_hash = sha256(p.token) AND live.rn = 1""",
)
def session_valid(x):
    tokens = x["events"].select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("T"), (F.col("event_id") % 5000).cast("string")).alias("token")
    )
    return governance.valid_sessions(tokens, x["f_sessions"], EVENTS_AS_OF)


_KEY = bytes(range(32))


@query("secure_view", "SELECT user_id, organization_id, email, first_name, last_name, role, status FROM {f_users}")
def secure_view(x):
    """Stored encrypted, read back through the decrypting view."""
    stored = encrypt_cols(x["f_users"], ["email"], _KEY)
    return governance.secure_users(stored, _KEY)


@query("encrypt_round_trip", "SELECT task_id, title, status FROM {f_tasks}")
def encrypt_round_trip(x):
    rows = x["f_tasks"].select("task_id", "title", "status")
    return decrypt_cols(encrypt_cols(rows, ["title", "status"], _KEY), ["title", "status"], _KEY)


@query(
    "hash_on_change",
    """SELECT user_id, CASE WHEN last_name IS NOT NULL AND user_id % 3 = 0
                            THEN CAST(user_id AS VARCHAR) || '$' || sha256(CAST(user_id AS VARCHAR) || last_name) ELSE last_name END AS secret
       FROM {f_users}""",
)
def hash_on_change_query(x):
    """A third of the secrets changed; only those are hashed."""
    old = F.when(F.col("user_id") % 3 != 0, F.col("last_name")).otherwise(F.lit("old"))
    return x["f_users"].select("user_id", hash_on_change(F.col("last_name"), old, F.col("user_id")).alias("secret"))


@query(
    "audit_split",
    """SELECT user_id, action, entity_type, entity_id, CASE WHEN action = 'UPDATE' THEN '{{"k":' || (log_id % 9) || '}}' END AS old_values,
              '{{"k":' || (log_id % 7) || '}}' AS new_values, CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS user_agent, created_at
       FROM {f_audit}""".replace("{{", "{").replace("}}", "}"),
)
def audit_split(x):
    k = F.struct((F.col("log_id") % 9).alias("k"))
    details = json_object(old=F.when(F.col("action") == "UPDATE", k), new=F.struct((F.col("log_id") % 7).alias("k")))
    return governance.audit_entries(x["f_audit"].withColumn("details", details))


@query(
    "audit_history",
    """WITH a AS (SELECT *, json_extract_string(new_values, '$.k') AS k, CASE WHEN action = 'CREATE' THEN NULL ELSE CAST(log_id % 100 AS VARCHAR) END AS before
                  FROM {f_audit} WHERE action IN ('CREATE', 'UPDATE', 'DELETE') AND entity_type = 'task')
       SELECT entity_id AS task_id, user_id AS changed_by, 'k' AS field_changed, before AS old_value, k AS new_value,
              CASE action WHEN 'CREATE' THEN 'INSERT' ELSE action END AS change_type, created_at AS changed_timestamp
       FROM a WHERE before IS DISTINCT FROM k""",
)
def audit_history(x):
    """Task history out of the JSON in the audit log."""
    old = F.when(F.col("action") != "CREATE", F.to_json(F.struct((F.col("log_id") % 100).alias("k"))))
    audit = x["f_audit"].filter(F.col("entity_type") == "task").withColumn("old_values", old)
    return facts.history_from_audit(audit, ["k"])


# -- checks -----------------------------------------------------------------------------


def _task_rules():
    return {
        "status_known": quality.in_vocabulary("status", ("backlog", "todo", "in_progress", "in_review")),
        "priority_known": quality.in_vocabulary("priority", VOCABULARY[("tasks", "priority")]),
        "title_present": quality.not_null("title"),
        "project_present": quality.not_null("project_id"),
        "title_length": quality.max_length("title", 8),
        "hours_fit": quality.fits_decimal("estimated_hours", 5, 2),
        "due_after_creation": quality.ordered("created_at", "due_date"),
    }


_BROKEN = {
    "status_known": "status NOT IN ('backlog', 'todo', 'in_progress', 'in_review')",
    "priority_known": "priority NOT IN ('critical', 'high', 'medium', 'low')",
    "title_present": "title IS NULL",
    "project_present": "project_id IS NULL",
    "title_length": "length(title) > 8",
    "hours_fit": "abs(estimated_hours) >= 1000",
    "due_after_creation": "due_date < created_at",
}


@query(
    "check_violations",
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations, count(*) AS row_count FROM {{f_tasks}}" for r, c in _BROKEN.items()
    ),
)
def check_violations(x):
    return quality.violation_counts(x["f_tasks"], _task_rules())


@query(
    "violating_rows",
    " UNION ALL ".join(f"SELECT task_id, '{r}' AS rule FROM {{f_tasks}} WHERE {c}" for r, c in _BROKEN.items()),
)
def violating_rows(x):
    return quality.violations(x["f_tasks"], _task_rules()).select("task_id", "rule")


_TABLE_CHECKS = {
    "status known": "status NOT IN ('backlog', 'todo', 'in_progress', 'in_review', 'done')",
    "priority known": "priority NOT IN ('critical', 'high', 'medium', 'low')",
    "organization_id present": "organization_id IS NULL",
    "title present": "title IS NULL",
    "status present": "status IS NULL",
    "priority present": "priority IS NULL",
    "title length": "length(title) > 255",
    "status length": "length(status) > 50",
    "priority length": "length(priority) > 20",
    "estimated_hours range": "abs(estimated_hours) >= 1000",
    "actual_hours range": "abs(actual_hours) >= 100000000",
}


@query(
    "table_report",
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations, count(*) AS row_count FROM {{f_tasks}}"
        for r, c in _TABLE_CHECKS.items()
    )
    + """ UNION ALL SELECT 'unique organization_id, task_id', (SELECT count(*) FROM (
            SELECT 1 FROM {f_tasks} GROUP BY organization_id, task_id HAVING count(*) > 1)), count(*) FROM {f_tasks}""",
)
def table_report(x):
    """Every declared constraint of the tasks table."""
    return quality.table_report("tasks", x["f_tasks"])


@query(
    "dup_keys",
    """SELECT task_id, user_id, start_time, count(*) AS copies FROM {f_time_logs}
       GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def dup_keys(x):
    return quality.duplicate_keys(x["f_time_logs"], ["task_id", "user_id", "start_time"])


@query(
    "fk_orphans",
    """SELECT c.comment_id, c.task_id FROM {f_comments} c
       WHERE c.task_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f_old_tasks} t WHERE t.task_id = c.task_id)""",
)
def fk_orphans(x):
    return quality.orphans(x["f_comments"], "task_id", x["f_old_tasks"], "task_id").select("comment_id", "task_id")


@query(
    "fk_orphan_counts",
    """SELECT l.task_id, count(*) AS row_count FROM {f_time_logs} l
       WHERE NOT EXISTS (SELECT 1 FROM {f_old_tasks} t WHERE t.task_id = l.task_id) GROUP BY 1""",
)
def fk_orphan_counts(x):
    return quality.orphan_counts(x["f_time_logs"], "task_id", x["f_old_tasks"], "task_id")


@query(
    "check_report",
    """WITH s AS (SELECT count(CASE WHEN status NOT IN ('backlog', 'todo', 'in_progress', 'in_review', 'done') THEN 1 END) AS bad,
                         count(CASE WHEN project_id IS NULL THEN 1 END) AS loose FROM {f_tasks}),
       d AS (SELECT count(*) AS n FROM (SELECT 1 FROM {f_time_logs} GROUP BY task_id, user_id, start_time HAVING count(*) > 1)),
       u AS (SELECT count(*) AS n FROM {f_users})
       SELECT 'task_status' AS setting_name, CAST(bad AS VARCHAR) AS current_value, '0' AS recommended_value,
              CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s
       UNION ALL SELECT 'tasks_without_project', CAST(loose AS VARCHAR), '0', CASE WHEN loose = 0 THEN 'PASS' ELSE 'WARNING' END FROM s
       UNION ALL SELECT 'duplicate_time_logs', CAST(n AS VARCHAR), '0', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM d
       UNION ALL SELECT 'user_count', CAST(n AS VARCHAR), '> 0', CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END FROM u""",
)
def check_report(x):
    tasks = x["f_tasks"].agg(
        F.count_if(~F.col("status").isin(*VOCABULARY[("tasks", "status")])).alias("bad"),
        F.count_if(F.col("project_id").isNull()).alias("loose"),
    )
    repeated = quality.duplicate_keys(x["f_time_logs"], ["task_id", "user_id", "start_time"]).agg(F.count(F.lit(1)).alias("n"))
    users = x["f_users"].agg(F.count(F.lit(1)).alias("n"))
    return quality.check_report(
        [
            quality.check("task_status", tasks, F.col("bad"), "0", F.col("bad") == 0),
            quality.check("tasks_without_project", tasks, F.col("loose"), "0", F.col("loose") == 0, "WARNING"),
            quality.check("duplicate_time_logs", repeated, F.col("n"), "0", F.col("n") == 0),
            quality.check("user_count", users, F.col("n"), "> 0", F.col("n") > 0),
        ]
    )


@query(
    "cascade_delete",
    """
    WITH RECURSIVE gone_users AS (SELECT user_id FROM {f_users} WHERE organization_id = 2),
    gone_projects AS (SELECT project_id FROM {f_projects} WHERE organization_id = 2),
    gone_tasks AS (
      SELECT task_id FROM {f_tasks} WHERE organization_id = 2
      UNION SELECT t.task_id FROM {f_tasks} t JOIN gone_tasks g ON t.parent_task_id = g.task_id)
    SELECT 'organizations' AS table_name, count(*) AS row_count, 0 AS nulled FROM region WHERE r_regionkey <> 2
    UNION ALL SELECT 'users', count(*), 0 FROM {f_users} WHERE user_id NOT IN (SELECT user_id FROM gone_users)
    UNION ALL SELECT 'projects', count(*), 0 FROM {f_projects} WHERE project_id NOT IN (SELECT project_id FROM gone_projects)
    UNION ALL SELECT 'tasks', count(*), count(CASE WHEN assigned_to IS NULL OR assigned_to IN (SELECT user_id FROM gone_users) THEN 1 END)
      FROM {f_tasks} WHERE task_id NOT IN (SELECT task_id FROM gone_tasks)
    UNION ALL SELECT 'time_logs', count(*), 0 FROM {f_time_logs}
      WHERE task_id NOT IN (SELECT task_id FROM gone_tasks) AND user_id NOT IN (SELECT user_id FROM gone_users)""",
)
def cascade_delete(x):
    """Row counts left after one organization is deleted."""
    organizations = x["region"].select(F.col("r_regionkey").alias("organization_id"))
    tables = {
        "organizations": organizations,
        "users": x["f_users"],
        "projects": x["f_projects"],
        "tasks": x["f_tasks"],
        "time_logs": x["f_time_logs"],
    }
    pks = {"organizations": "organization_id", "users": "user_id", "projects": "project_id", "tasks": "task_id"}
    ids = organizations.filter(F.col("organization_id") == 2)
    left = quality.delete_with_refs(tables, "organizations", ids, pks)
    out = None
    for name, df in left.items():
        nulled = F.count_if(F.col("assigned_to").isNull()) if name == "tasks" else F.lit(0)
        row = df.agg(F.count(F.lit(1)).alias("row_count"), nulled.cast("bigint").alias("nulled"))
        row = row.select(F.lit(name).alias("table_name"), "row_count", "nulled")
        out = row if out is None else out.unionByName(row)
    return out


# -- operational questions -----------------------------------------------------------------


@query(
    "slow_ops",
    f"""SELECT source_system, count(*) AS calls, {dec(f'coalesce(sum({_TOOK}), 0)', 6)} AS total_seconds,
               {dec(f'avg({_TOOK})', 4)} AS mean_seconds,
               {half_up("100 * count(CASE WHEN status = 'COMPLETED' THEN 1 END)", "count(CASE WHEN status <> 'RUNNING' THEN 1 END)")} AS hit_percent
        FROM {{f_batches}} WHERE source_system NOT LIKE '%9' GROUP BY 1
        ORDER BY mean_seconds DESC NULLS LAST, source_system LIMIT 5""",
)
def slow_ops(x):
    hit = F.when(F.col("status") != "RUNNING", F.col("status") == "COMPLETED")
    return opmetrics.slowest(x["f_batches"], "source_system", "batch_start_time", "batch_end_time", hit, 5, "%9")


@query(
    "hit_ratio",
    f"""SELECT source_system, count(*) AS total_operations, CAST(sum(records_processed) AS BIGINT) AS total_changes,
               count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS hits, count(CASE WHEN status = 'FAILED' THEN 1 END) AS misses,
               {half_up("100 * count(CASE WHEN status = 'COMPLETED' THEN 1 END)", "count(CASE WHEN status <> 'RUNNING' THEN 1 END)")} AS hit_ratio
        FROM {{f_batches}} WHERE source_system NOT IN ('S0', 'S1') GROUP BY 1""",
)
def hit_ratio(x):
    hit = F.when(F.col("status") != "RUNNING", F.col("status") == "COMPLETED")
    return opmetrics.throughput(x["f_batches"], "source_system", hit, F.col("records_processed"), ("S0", "S1"))


@query(
    "threshold_ratio",
    f"""WITH g AS (SELECT user_id, count(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 END) AS live_rows,
                          count(CASE WHEN event_type IN ('error', 'view') THEN 1 END) AS dead_rows FROM events GROUP BY 1)
        SELECT user_id, live_rows, dead_rows, CAST(2 + 0.35 * (live_rows + dead_rows) AS DOUBLE) AS threshold,
               {half_up('100 * dead_rows', 'live_rows + dead_rows')} AS dead_ratio
        FROM g WHERE 100 * dead_rows > 200 + 35 * (live_rows + dead_rows)""",
)
def threshold_ratio(x):
    return opmetrics.over_threshold(x["events"], "user_id", F.col("event_type").isin("error", "view"), 2, "0.35")


@query(
    "dup_groups",
    """SELECT sha256(text) AS text_hash, CAST(0 AS INTEGER) AS part, count(*) AS member_count, CAST(sum(n_chars) AS BIGINT) AS total_size,
              string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members
       FROM documents GROUP BY text HAVING count(*) > 1""",
)
def dup_groups(x):
    """Documents with equal text, listed with their group."""
    docs = x["documents"].select(F.sha2("text", 256).alias("text_hash"), "doc_id", "n_chars")
    groups = opmetrics.duplicate_groups(docs, ["text_hash"], "doc_id", F.col("n_chars"))
    return groups.withColumn("members", F.array_join("members", ","))


@query(
    "low_use",
    f"""SELECT u.user_id, count(CASE WHEN e.event_type <> 'error' THEN 1 END) AS use_count,
               {half_up("100 * count(CASE WHEN e.event_type <> 'error' THEN 1 END)", 'count(e.event_id)')} AS use_ratio
        FROM {{f_users}} u LEFT JOIN events e ON e.user_id = u.user_id
        GROUP BY 1 HAVING count(CASE WHEN e.event_type <> 'error' THEN 1 END) < 50""",
)
def low_use(x):
    return opmetrics.low_use(x["f_users"], "user_id", x["events"], "user_id", F.col("event_type") == "error")


@query(
    "activity_counts",
    """SELECT action, entity_type, entity_id, CAST(hour(created_at) AS INTEGER) AS hour, user_id % 5 AS team, count(*) AS activity_count
       FROM {f_audit} WHERE user_id <> 7 GROUP BY 1, 2, 3, 4, 5""",
)
def activity_counts(x):
    log = x["f_audit"].withColumns({"hour": F.hour("created_at"), "team": F.col("user_id") % 5})
    return opmetrics.activity_counts(log, ["action", "entity_type", "entity_id", "hour", "team"], "user_id", 7)


@query(
    "long_running",
    f"""SELECT batch_id, source_system, batch_start_time,
               {dec("(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(batch_start_time)) / 1000000.0", 6)} AS duration_seconds
        FROM {{f_batches}} WHERE status = 'RUNNING' AND batch_start_time < TIMESTAMP '2024-01-30 23:55:00'""",
)
def long_running(x):
    rows = opmetrics.running_longer(x["f_batches"], "batch_start_time", EVENTS_AS_OF, 5, F.col("status") != "RUNNING")
    return rows.select("batch_id", "source_system", "batch_start_time", "duration_seconds")


@query(
    "blocking_pairs",
    """WITH p AS (SELECT w.request_id, w.pid, w.locktype, w.relation, w.granted, h.pid AS holder FROM {f_locks} w
                  JOIN (SELECT DISTINCT pid, locktype, relation FROM {f_locks} WHERE granted) h
                    ON w.locktype IS NOT DISTINCT FROM h.locktype AND w.relation IS NOT DISTINCT FROM h.relation AND w.pid <> h.pid
                  WHERE NOT w.granted),
       f AS (SELECT locktype, relation, min(pid) AS lo, max(pid) AS hi FROM {f_locks} WHERE granted GROUP BY 1, 2)
       SELECT p.request_id, p.pid, p.locktype, p.relation, p.granted, count(*) AS blocker_count,
              any_value(CASE WHEN f.lo <> p.pid THEN f.lo ELSE f.hi END) AS blocking_pid
       FROM p JOIN f ON p.locktype IS NOT DISTINCT FROM f.locktype AND p.relation IS NOT DISTINCT FROM f.relation
       GROUP BY 1, 2, 3, 4, 5""",
)
def blocking_pairs(x):
    """Waiting requests with the number of processes that block them."""
    return opmetrics.waiting_requests(x["f_locks"], "pid", ["locktype", "relation"], "granted")


@query(
    "blockers_of",
    """SELECT DISTINCT w.pid AS blocked_pid, h.pid AS blocking_pid, w.locktype, w.relation FROM {f_locks} w JOIN {f_locks} h
         ON w.locktype IS NOT DISTINCT FROM h.locktype AND w.relation IS NOT DISTINCT FROM h.relation AND w.pid <> h.pid
       WHERE NOT w.granted AND h.granted AND w.pid = 12""",
)
def blockers_of(x):
    return opmetrics.blockers_of(x["f_locks"], 12, "pid", ["locktype", "relation"], "granted")


@query(
    "share_of_total",
    """SELECT source, CAST(sum(n_chars) AS BIGINT) AS amount,
              CAST((20 * 100 * CAST(sum(n_chars) AS BIGINT) + (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents))
                   // (2 * (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents)) AS DOUBLE) / 10 AS percent
       FROM documents GROUP BY 1""",
)
def share_of_total(x):
    return opmetrics.share_of_total(x["documents"], "source", F.col("n_chars"))


@query(
    "lag",
    f"""SELECT max(ts) AS latest, {dec("(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1000000.0", 6)} AS lag_seconds
        FROM events""",
)
def lag(x):
    return opmetrics.lag_seconds(x["events"], "ts", EVENTS_AS_OF)


def _pretty(n: str) -> str:
    units = [("kB", 512), ("MB", 512 * 1024), ("GB", 512 * 1024**2), ("TB", 512 * 1024**3)]
    cases = " ".join(f"WHEN {n} // {half} < 20479 THEN CAST(({n} // {half} + 1) // 2 AS VARCHAR) || ' {unit}'" for unit, half in units)
    return f"CASE WHEN {n} < 10240 THEN CAST({n} AS VARCHAR) || ' bytes' {cases} END"


@query(
    "size_report",
    f"""WITH g AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(sum(strlen(split_part(text, chr(10), 1))) AS BIGINT) AS part_bytes
                   FROM documents GROUP BY 1),
        r AS (SELECT *, total_bytes - part_bytes AS other_bytes FROM g)
        SELECT source, total_bytes, part_bytes, other_bytes, {_pretty('total_bytes')} AS total_size,
               {_pretty('part_bytes')} AS part_size, {_pretty('other_bytes')} AS other_size FROM r""",
)
def size_report(x):
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    return opmetrics.size_report(x["documents"], "source", F.octet_length("text"), F.octet_length(first_line))


@query(
    "table_activity",
    """SELECT entity_type, count(CASE WHEN action = 'CREATE' THEN 1 END) AS inserted_rows, count(CASE WHEN action = 'UPDATE' THEN 1 END) AS updated_rows,
              count(CASE WHEN action = 'DELETE' THEN 1 END) AS deleted_rows, count(CASE WHEN action IN ('UPDATE', 'DELETE') THEN 1 END) AS dead_rows,
              max(created_at) AS last_change
       FROM {f_audit} GROUP BY 1""",
)
def table_activity(x):
    action = F.col("action")
    return opmetrics.table_activity(
        x["f_audit"], "entity_type", "created_at", action == "CREATE", action == "UPDATE", action == "DELETE"
    )


# -- scheduled runs ----------------------------------------------------------------------


@query(
    "newest_event_per_user",
    """SELECT user_id, event_id, ts, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def newest_event_per_user(x):
    """The events folder streamed to its end, newest row per user kept."""
    import uuid

    from workmill.streaming.incremental import NewestTable, run_available, upsert_into

    root = f"{shared_folder(x.spark)}/newest-{uuid.uuid4()}"
    table = NewestTable(x.spark, f"{root}/table", "user_id", ["ts", "event_id"])
    keep = upsert_into(table, lambda df: df.select("user_id", "event_id", "ts", "event_type"))
    run_available(x.spark, x.folder, x["events"].schema, f"{root}/state", keep, "events.parquet")
    return table.read()


