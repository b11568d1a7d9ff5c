"""The model's views and routines by their SQL names.

`register` makes them session-temporary over tables already known to the
session (temporary views or catalog tables named like the source model), so
existing SQL keeps working: `SELECT * FROM task_metrics`,
`SELECT * FROM check_etl_status(48)`, `SELECT has_permission(7, 'view_tasks')`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from workmill.functions.moments import parse
from workmill.operators import quality
from workmill.operators.governance import secure_users
from workmill.plans import reports


def _has(spark: SparkSession, *names: str) -> bool:
    return all(spark.catalog.tableExists(n) for n in names)


# The session variable that holds the tenant.
ORGANIZATION = "current_organization_id"


def register(spark: SparkSession, as_of=None, email_key: bytes | None = None) -> list[str]:
    """Create every view and function whose tables are there; returns names.

    With `as_of` they all answer as of that time; without, as of the time of
    each call.
    """
    made = []
    moment = "localtimestamp()" if as_of is None else f"TIMESTAMP_NTZ '{parse(as_of):%Y-%m-%d %H:%M:%S.%f}'"
    as_of = F.localtimestamp() if as_of is None else as_of

    if _has(spark, "tasks", "projects"):
        reports.task_metrics(spark.table("tasks"), spark.table("projects"), as_of).createOrReplaceTempView("task_metrics")
        made.append("task_metrics")
    if _has(spark, "users", "tasks", "time_logs"):
        rows = reports.user_workload(spark.table("users"), spark.table("tasks"), spark.table("time_logs"), as_of)
        rows.createOrReplaceTempView("user_workload")
        made.append("user_workload")
    if email_key is not None and _has(spark, "users"):
        secure_users(spark.table("users"), email_key).createOrReplaceTempView("users_secure")
        made.append("users_secure")

    def function(name: str, arguments: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
        made.append(name)

    if _has(spark, "etl_batch_log"):
        reports.latest_batch(spark.table("etl_batch_log")).createOrReplaceTempView("latest_etl_batch")
        latest = ", ".join(f"{n} {t}" for n, t in spark.table("latest_etl_batch").dtypes)
        function("get_latest_etl_batch", "", f"TABLE({latest})", "SELECT * FROM latest_etl_batch")
        minutes = "CAST(CAST(batch_end_time - batch_start_time AS INTERVAL SECOND) AS DECIMAL(18,6)) / 60.0"
        function(
            "check_etl_status",
            "hours_back INT DEFAULT 24",
            "TABLE(batch_id STRING, batch_start_time TIMESTAMP_NTZ, batch_end_time TIMESTAMP_NTZ, status STRING, "
            "duration_minutes DECIMAL(24,10), records_processed BIGINT, error_message STRING)",
            f"SELECT batch_id, batch_start_time, batch_end_time, status, {minutes}, records_processed, error_message "
            f"FROM etl_batch_log WHERE batch_start_time >= {moment} - make_dt_interval(0, check_etl_status.hours_back) "
            "ORDER BY batch_start_time DESC",
        )
    if _has(spark, "users"):
        kind = dict(spark.table("users").dtypes)["user_id"]
        function(
            "has_permission",
            f"who {kind}, wanted STRING",
            "BOOLEAN",
            """coalesce(CASE (SELECT max(u.role) FROM users u WHERE u.user_id = has_permission.who)
                 WHEN 'admin' THEN true
                 WHEN 'manager' THEN wanted IN ('view_reports', 'manage_tasks')
                 WHEN 'member' THEN wanted = 'view_tasks' END, false)""",
        )
    if _has(spark, "user_sessions"):
        kinds = dict(spark.table("user_sessions").dtypes)
        function(
            "validate_session",
            "token STRING",
            f"TABLE(is_valid BOOLEAN, user_id {kinds['user_id']}, session_id {kinds['session_id']})",
            f"""SELECT s IS NOT NULL, s.user_id, s.session_id FROM (
                 SELECT max(struct(expires_at, session_id, user_id)) AS s FROM user_sessions
                 WHERE token_hash = sha2(validate_session.token, 256) AND expires_at > {moment} AND NOT is_revoked)""",
        )
    if _has(spark, "encryption_keys"):
        key = """coalesce((SELECT max(k.key_value) FROM encryption_keys k WHERE k.key_name = {0}.key_name),
                 raise_error(concat('no key is stored under the name ', {0}.key_name)))"""
        function("encrypt_data", "data STRING, key_name STRING", "BINARY", f"aes_encrypt(encrypt_data.data, {key.format('encrypt_data')}, 'GCM')")
        function("decrypt_data", "encrypted_data BINARY, key_name STRING", "STRING", f"CAST(aes_decrypt(decrypt_data.encrypted_data, {key.format('decrypt_data')}, 'GCM') AS STRING)")
        stored = spark.table("encryption_keys").agg(F.count(F.lit(1)).alias("n"))
        one = spark.range(1)
        ssl = F.lit("on" if spark.conf.get("spark.ssl.enabled", "false") == "true" else "off")
        quality.check_report(
            [
                quality.check("ssl", one, ssl, "on", ssl == "on"),
                quality.check("password_encryption", one, F.lit("sha-256"), "sha-256", F.lit(True), "WARNING"),
                quality.check("row_security", one, F.lit("enabled"), "enabled", F.lit(True)),
                quality.check("encryption_keys_count", stored, F.col("n"), "> 0", F.col("n") > 0),
            ]
        ).createOrReplaceTempView("security_audit_rows")
        function("security_audit", "", "TABLE(setting_name STRING, current_value STRING, recommended_value STRING, status STRING)", "SELECT * FROM security_audit_rows")
    return made


def set_organization(spark: SparkSession, organization: str | None) -> None:
    """Set the tenant that `get_current_organization_id()` returns, NULL for none."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ORGANIZATION} STRING DEFAULT NULL")
    if organization is not None:
        spark.sql(f"SET VAR {ORGANIZATION} = :organization", args={"organization": str(organization)})
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION get_current_organization_id() RETURNS STRING RETURN {ORGANIZATION}")
