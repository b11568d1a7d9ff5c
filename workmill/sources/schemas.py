"""Declared schemas: the union of both source-model versions, the warehouse
tables and the control tables. UUIDs are strings, JSON is text, timestamps are
UTC without a zone. Columns that only one model version has are nullable."""

from __future__ import annotations

from pyspark.sql.types import StructType

SOURCE = {
    "organizations": "organization_id string, name string, subdomain string, status string, metadata string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz",
    "users": "user_id string, organization_id string, email string, password_hash string, first_name string, "
    "last_name string, role string, status string, email_verified_at timestamp_ntz, last_login_at timestamp_ntz, "
    "preferences string, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz, username string, "
    "department string, manager_id string, hire_date date, email_encrypted binary, deleted_at timestamp_ntz",
    "projects": "project_id string, organization_id string, name string, description string, status string, "
    "start_date date, due_date date, budget decimal(12,2), custom_fields string, created_by string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz",
    "tasks": "task_id string, organization_id string, project_id string, parent_task_id string, title string, "
    "description string, status string, priority string, due_date timestamp_ntz, estimated_hours decimal(10,2), "
    "actual_hours decimal(10,2), custom_fields string, created_by string, assigned_to string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz, task_sk string, "
    "reporter_id string, story_points decimal(5,2), is_blocked boolean, block_reason string, task_type string, "
    "labels array<string>, status_changed_at timestamp_ntz",
    "task_assignments": "task_id string, organization_id string, user_id string, assigned_at timestamp_ntz, "
    "assigned_by string, role string, created_at timestamp_ntz",
    "comments": "comment_id string, organization_id string, task_id string, user_id string, content string, "
    "parent_comment_id string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "deleted_at timestamp_ntz",
    "attachments": "attachment_id string, organization_id string, task_id string, file_name string, "
    "file_type string, file_size bigint, storage_key string, file_path string, mime_type string, "
    "uploaded_by string, uploaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "time_logs": "log_id string, organization_id string, task_id string, user_id string, start_time timestamp_ntz, "
    "end_time timestamp_ntz, duration_minutes int, description string, billable boolean, "
    "hourly_rate decimal(10,2), created_at timestamp_ntz, updated_at timestamp_ntz",
    "notifications": "notification_id string, organization_id string, user_id string, type string, title string, "
    "message string, metadata string, is_read boolean, read_at timestamp_ntz, scheduled_for timestamp_ntz, "
    "created_at timestamp_ntz, reference_id string, reference_type string",
    "audit_logs": "log_id bigint, organization_id string, user_id string, action string, entity_type string, "
    "entity_id string, old_values string, new_values string, ip_address string, user_agent string, "
    "created_at timestamp_ntz",
    "tags": "tag_id string, organization_id string, name string, color_code string, type string, "
    "created_at timestamp_ntz, deleted_at timestamp_ntz",
    "task_tags": "task_id string, organization_id string, tag_id string, created_at timestamp_ntz",
    "user_sessions": "session_id string, user_id string, token_hash string, ip_address string, user_agent string, "
    "expires_at timestamp_ntz, created_at timestamp_ntz, last_activity timestamp_ntz, is_revoked boolean",
}

_VERSIONED = (
    "effective_date timestamp_ntz, expiry_date timestamp_ntz, is_current boolean, version_number int, "
    "{source}etl_batch_id string, etl_timestamp timestamp_ntz"
)
_WITH_SOURCE = _VERSIONED.format(source="source_system string, ")
_NO_SOURCE = _VERSIONED.format(source="")

WAREHOUSE = {
    "dim_time": "time_key int, full_date date, day_of_week smallint, day_name string, day_of_month smallint, "
    "day_of_year smallint, week_of_year smallint, month_number smallint, month_name string, "
    "quarter_number smallint, year_number int, is_weekend boolean, is_holiday boolean, holiday_name string, "
    "effective_date date, expiry_date date, is_current boolean",
    "dim_users": "user_key int, user_id string, username string, email string, first_name string, "
    "last_name string, role string, status string, department string, manager_id string, hire_date date, "
    + _WITH_SOURCE,
    "dim_projects": "project_key int, project_id string, project_name string, project_code string, "
    "description string, status string, priority string, start_date date, end_date date, budget decimal(15,2), "
    "client_name string, manager_id string, " + _WITH_SOURCE,
    "dim_task_status": "status_key int, status_id string, status_name string, status_category string, "
    "is_active boolean, " + _NO_SOURCE,
    "dim_priority": "priority_key int, priority_id string, priority_name string, priority_level int, "
    "is_active boolean, " + _NO_SOURCE,
    "fact_tasks": "task_key bigint, task_id string, task_sk string, project_key int, assigned_to_key int, "
    "reporter_key int, status_key int, priority_key int, created_date_key int, due_date_key int, "
    "completed_date_key int, title string, description string, estimated_hours decimal(10,2), "
    "actual_hours decimal(10,2), story_points decimal(5,2), is_blocked boolean, block_reason string, "
    "parent_task_id string, task_type string, labels array<string>, created_timestamp timestamp_ntz, "
    "updated_timestamp timestamp_ntz, days_open int, days_in_progress int, days_in_review int, "
    "days_completed int, is_overdue boolean, days_overdue int, completion_ratio decimal(5,2), "
    "etl_batch_id string, etl_timestamp timestamp_ntz",
    "fact_time_logs": "time_log_key bigint, time_log_id string, task_key bigint, user_key int, project_key int, "
    "date_key int, start_time_key int, end_time_key int, start_timestamp timestamp_ntz, "
    "end_timestamp timestamp_ntz, duration_minutes decimal(10,2), duration_hours decimal(10,2), "
    "billable_hours decimal(10,2), billing_rate decimal(15,2), billing_amount decimal(15,2), "
    "is_billable boolean, description string, activity_type string, approval_status string, approved_by int, "
    "approval_timestamp timestamp_ntz, etl_batch_id string, etl_timestamp timestamp_ntz",
    "fact_task_history": "history_key bigint, task_key bigint, changed_by_key int, changed_date_key int, "
    "changed_timestamp timestamp_ntz, field_changed string, old_value string, new_value string, "
    "change_type string, change_description string, etl_batch_id string, etl_timestamp timestamp_ntz",
    "bridge_task_assignees": "task_key bigint, user_key int, is_primary boolean, assignment_date_key int, "
    "assignment_timestamp timestamp_ntz, etl_batch_id string, etl_timestamp timestamp_ntz",
    "agg_daily_task_metrics": "date_key int, project_key int, status_key int, priority_key int, task_count int, "
    "open_tasks int, in_progress_tasks int, completed_tasks int, blocked_tasks int, overdue_tasks int, "
    "avg_days_open decimal(10,2), avg_days_to_complete decimal(10,2), total_story_points int, "
    "completed_story_points int, completion_ratio decimal(5,2), etl_batch_id string, etl_timestamp timestamp_ntz",
    "agg_user_workload": "date_key int, user_key int, project_key int, assigned_tasks int, completed_tasks int, "
    "open_tasks int, in_progress_tasks int, overdue_tasks int, total_hours_logged decimal(10,2), "
    "avg_hours_per_task decimal(10,2), billable_hours decimal(10,2), non_billable_hours decimal(10,2), "
    "utilization_percentage decimal(5,2), etl_batch_id string, etl_timestamp timestamp_ntz",
}

CONTROL = {
    "etl_batch_log": "batch_id string, batch_start_time timestamp_ntz, batch_end_time timestamp_ntz, "
    "status string, source_system string, records_processed bigint, records_inserted bigint, records_updated bigint, "
    "records_failed bigint, error_message string, created_by string, created_timestamp timestamp_ntz, "
    "parent_batch_id string, details string",
    "etl_error_log": "error_id string, batch_id string, error_timestamp timestamp_ntz, error_severity string, "
    "error_code string, error_message string, source_table string, source_key string, error_data string, "
    "resolved boolean, resolved_by string, resolved_timestamp timestamp_ntz, resolution_notes string",
    "etl_audit_log": "audit_id string, batch_id string, table_name string, operation_type string, "
    "records_affected bigint, start_time timestamp_ntz, end_time timestamp_ntz, status string, "
    "error_message string, execution_time_seconds decimal(10,2), details string",
}

TABLES = {**SOURCE, **WAREHOUSE, **CONTROL}

# Closed vocabularies (fixed values).
VOCABULARY = {
    ("organizations", "status"): ("active", "suspended", "deleted"),
    ("users", "role"): ("admin", "manager", "member", "guest"),
    ("users", "status"): ("pending", "active", "suspended", "inactive"),
    ("projects", "status"): ("planning", "active", "on_hold", "completed", "cancelled"),
    ("tasks", "status"): ("backlog", "todo", "in_progress", "in_review", "done"),
    ("tasks", "priority"): ("critical", "high", "medium", "low"),
    ("task_assignments", "role"): ("assignee", "reviewer", "watcher"),
    ("audit_logs", "action"): ("CREATE", "UPDATE", "DELETE", "LOGIN", "LOGOUT", "PERMISSION_CHANGE"),
    ("tags", "type"): ("CATEGORY", "PRIORITY", "STATUS", "CUSTOM"),
}

# Columns that must have a value (fixed values).
REQUIRED = {
    "organizations": ("name", "subdomain", "status"),
    "users": ("organization_id", "email", "password_hash", "role", "status"),
    "projects": ("organization_id", "name", "status", "created_by"),
    "tasks": ("organization_id", "title", "status", "priority", "created_by"),
    "task_assignments": ("task_id", "organization_id", "user_id", "assigned_by", "role"),
    "comments": ("organization_id", "task_id", "user_id", "content"),
    "attachments": ("organization_id", "task_id", "file_name", "file_size", "uploaded_by"),
    "time_logs": ("organization_id", "task_id", "user_id", "start_time"),
    "notifications": ("organization_id", "user_id", "type", "title", "message"),
    "audit_logs": ("action", "entity_type"),
    "tags": ("organization_id", "name", "type"),
    "task_tags": ("task_id", "organization_id", "tag_id"),
    "user_sessions": ("user_id", "token_hash", "expires_at"),
}

# Longest text per column (fixed values).
LENGTHS = {
    "organizations": {"name": 255, "subdomain": 100, "status": 20},
    "users": {"email": 255, "password_hash": 255, "first_name": 100, "last_name": 100, "role": 50, "status": 20},
    "projects": {"name": 255, "status": 50},
    "tasks": {"title": 255, "status": 50, "priority": 20},
    "task_assignments": {"role": 20},
    "attachments": {"file_name": 255, "file_type": 50, "storage_key": 255, "mime_type": 100},
    "notifications": {"type": 50, "title": 255},
    "audit_logs": {"action": 50, "entity_type": 50},
    "tags": {"name": 50, "color_code": 7, "type": 50},
}

# Precision and scale of decimal columns (fixed values).
DECIMALS = {
    "projects": {"budget": (12, 2)},
    "tasks": {"estimated_hours": (5, 2), "actual_hours": (10, 2)},
    "time_logs": {"hourly_rate": (10, 2)},
}

# Keys that identify one row (fixed values).
UNIQUE = {
    "organizations": (("organization_id",), ("subdomain",)),
    "users": (("user_id",), ("organization_id", "email")),
    "projects": (("project_id",),),
    "tasks": (("organization_id", "task_id"),),
    "task_assignments": (("task_id", "organization_id", "user_id"),),
    "comments": (("comment_id",),),
    "attachments": (("attachment_id",),),
    "notifications": (("notification_id",),),
    "tags": (("tag_id",), ("organization_id", "name", "type")),
    "task_tags": (("task_id", "organization_id", "tag_id"),),
    "user_sessions": (("session_id",),),
    "dim_time": (("full_date", "effective_date"),),
    "dim_task_status": (("status_id", "effective_date"),),
    "dim_priority": (("priority_id", "effective_date"),),
    "fact_tasks": (("task_id", "created_date_key"),),
    "bridge_task_assignees": (("task_key", "user_key"),),
    "agg_daily_task_metrics": (("date_key", "project_key", "status_key", "priority_key"),),
    "agg_user_workload": (("date_key", "user_key", "project_key"),),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def with_keys(name: str, key_type: str) -> StructType:
    """The declared schema with id columns of another type (e.g. bigint ids)."""
    parts = []
    for field in schema(name):
        is_id = field.name.endswith("_id") and field.name not in ("batch_id", "etl_batch_id", "parent_batch_id")
        is_user = field.name in ("created_by", "assigned_to", "assigned_by", "uploaded_by")
        kind = key_type if field.dataType.simpleString() == "string" and (is_id or is_user) else field.dataType.simpleString()
        parts.append(f"{field.name} {kind}")
    return StructType.fromDDL(", ".join(parts))
