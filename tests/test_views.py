"""The views and routines by their SQL names."""

import pytest

from workmill.functions.crypto import encrypt_cols
from workmill.plans import registry, views
from workmill.sources.projection import Inputs

from compare import TESTDATA
from pyspark.sql import functions as F

SF = f"{TESTDATA}/sf0.001"


def test_sql_names(spark):
    x = Inputs(spark, SF)
    key = bytes(range(32))
    users = encrypt_cols(x["f_users"].withColumn("plain", F.col("email")), ["email"], key).withColumn("email", F.col("plain"))
    tables = {
        "users": users.drop("plain"),
        "tasks": x["f_tasks"],
        "projects": x["f_projects"],
        "time_logs": x["f_time_logs"],
        "etl_batch_log": x["f_batches"].withColumn("error_message", F.lit(None).cast("string")),
        "user_sessions": x["f_sessions"],
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    made = views.register(spark, registry.AS_OF, key)
    assert set(made) == {
        "task_metrics", "user_workload", "users_secure", "get_latest_etl_batch", "check_etl_status", "has_permission", "validate_session",
    }
    assert spark.sql("SELECT sum(done_count) FROM task_metrics").first()[0] == x["f_tasks"].filter("status = 'done'").count()
    assert spark.sql("SELECT count(*) FROM user_workload").first()[0] == 150
    assert spark.sql("SELECT email FROM users_secure WHERE user_id = 3").first()[0] == "customer#000000003@example.com"
    assert spark.sql("SELECT batch_id FROM get_latest_etl_batch()").first()[0] == "B999"

    views.register(spark, registry.EVENTS_AS_OF, key)
    day = spark.sql("SELECT count(*) FROM check_etl_status()").first()[0]
    assert 0 <= day < spark.sql("SELECT count(*) FROM check_etl_status(240)").first()[0]
    got = spark.sql(
        "SELECT has_permission(4, 'anything'), has_permission(1, 'view_reports'), has_permission(1, 'x'), has_permission(-5, 'x')"
    ).first()
    assert got[:] == (True, True, False, False)
    assert spark.sql("SELECT * FROM validate_session('nobody')").first()[:] == (False, None, None)
    token = x["f_sessions"].filter("NOT is_revoked AND expires_at > TIMESTAMP_NTZ '2024-01-31'").orderBy("session_id").first()["session_id"]
    assert spark.sql(f"SELECT is_valid FROM validate_session('T{token % 4000}')").first()[0]
    for name in tables:
        spark.catalog.dropTempView(name)


def test_keys_audit_and_tenant_by_their_sql_names(spark):
    spark.createDataFrame([("main", bytearray(range(32))), ("other", bytearray(range(1, 33)))], "key_name string, key_value binary").createOrReplaceTempView("encryption_keys")
    spark.range(500).selectExpr("concat('B', id) AS batch_id", "localtimestamp() - make_dt_interval(0, id) AS batch_start_time", "localtimestamp() AS batch_end_time", "'COMPLETED' AS status", "id AS records_processed", "CAST(NULL AS STRING) AS error_message").createOrReplaceTempView("etl_batch_log")
    made = views.register(spark)
    assert {"encrypt_data", "decrypt_data", "security_audit", "check_etl_status"} <= set(made)
    assert spark.sql("SELECT decrypt_data(encrypt_data('héllo', 'main'), 'main')").first()[0] == "héllo"
    assert spark.sql("SELECT encrypt_data('a', 'main') = encrypt_data('a', 'other')").first()[0] is False
    with pytest.raises(Exception, match="no key is stored under the name missing"):
        spark.sql("SELECT encrypt_data('a', 'missing')").collect()
    rows = {r["setting_name"]: r for r in spark.sql("SELECT * FROM security_audit()").collect()}
    assert (rows["encryption_keys_count"]["current_value"], rows["encryption_keys_count"]["status"], rows["ssl"]["status"]) == ("2", "PASS", "FAIL")
    newest = [r["batch_id"] for r in spark.sql("SELECT * FROM check_etl_status(5)").collect()]
    assert newest[:5] == ["B0", "B1", "B2", "B3", "B4"] and len(newest) <= 6
    views.set_organization(spark, "o'7")
    assert spark.sql("SELECT get_current_organization_id()").first()[0] == "o'7"
    views.set_organization(spark, None)
    assert spark.sql("SELECT get_current_organization_id()").first()[0] is None
    for name in ("encryption_keys", "etl_batch_log"):
        spark.catalog.dropTempView(name)
