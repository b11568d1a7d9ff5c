"""Plan shapes that must hold whatever the data size."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module  # noqa: F401
from workmill.plans import registry
from workmill.operators.lookup import lookup
from workmill.plans import reports
from workmill.sources.projection import Inputs

from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"
QUERIES = registry.QUERIES


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set session values for one test."""
    old = {}

    def put(**values):
        for name, value in values.items():
            name = name.replace("__", ".")
            old.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_no_global_window(name, spark, conf):
    # Nothing may rest on a broadcast: plan as if every table were large.
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = executed(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in text, bad
    # Windows over one row per partition, or within one range of one key.
    if name not in ("surrogate_keys", "dense_keys", "scd2_as_of_merge"):
        assert "Window [" not in text


def hot_logs(spark):
    """A third of all rows on one key."""
    logs = spark.range(0, 300000, 1, 8).select(
        F.col("id").alias("log_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("task_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )
    tasks = spark.range(5000).select(F.col("id").alias("tid"), (F.col("id") + 1).alias("task_key"))
    return logs, tasks


def test_hot_key_of_a_lookup_is_split(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200k",
    )
    logs, tasks = hot_logs(spark)
    found = lookup(logs, tasks, "task_id", "tid", {"task_key": "task_key"})
    out = found.groupBy("task_key").agg(F.count(F.lit(1)).alias("n"), F.max("note").alias("note"))
    rows = {r["task_key"]: r["n"] for r in out.collect()}
    assert rows[8] == 100000 + sum(1 for i in range(300000) if i % 3 and i % 5000 == 7)
    assert "skew=true" in executed(out)


def test_hours_are_summed_before_the_join(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    x = Inputs(spark, SF)
    df = reports.hours_by_project(x["f_time_logs"], x["f_tasks"], x["f_projects"])
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # Below each join with tasks or projects there is an aggregate of the logs.
    lines = text.splitlines()
    joins = [i for i, line in enumerate(lines) if "Join Inner, (task_id" in line]
    assert joins and any("Aggregate [task_id" in line for line in lines[joins[0]:])


def test_classification_reads_few_columns_of_the_fact(spark, tmp_path):
    from workmill.operators import facts
    from workmill.plans.registry import AS_OF, DONE

    x = Inputs(spark, SF)
    stored = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE).withColumn("task_key", F.col("task_id"))
    stored.write.parquet(f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    load = facts.load_fact_tasks(fact, x["f_tasks"], x.dims, AS_OF, **DONE)
    scan = next(line for line in executed(load.counts()).splitlines() if "FileScan parquet" in line and f"{tmp_path}" in line)
    named = re.findall(r"\w+(?=#)", scan)
    assert set(named) <= {"task_id", "task_key", *facts.TRACKED} and "title" in named


def test_a_small_load_does_not_shuffle_the_fact(spark, tmp_path, conf):
    from workmill.operators import facts
    from workmill.plans.registry import AS_OF, DONE

    x = Inputs(spark, SF)
    stored = facts.resolve_tasks(x["f_tasks"], x.dims, AS_OF, "B1", **DONE).withColumn("task_key", F.col("task_id"))
    stored.write.parquet(f"{tmp_path}/fact")
    x["f_tasks"].filter("task_id < 20").withColumn("priority", F.lit("low")).coalesce(1).write.parquet(f"{tmp_path}/delta")
    fact, delta = spark.read.parquet(f"{tmp_path}/fact"), spark.read.parquet(f"{tmp_path}/delta")
    load, kinds = facts.load_fact_tasks(fact, delta, x.dims, AS_OF, **DONE).settled()
    low = x["f_tasks"].filter("task_id < 20 AND priority = 'low'").count()
    assert kinds == {"new": 0, "changed": 20 - low, "unchanged": low}
    text = load.merged()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [task_id" in text and "hashpartitioning" not in text
    # Too many ids to broadcast: the plain join gives the same.
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    assert facts.load_fact_tasks(fact, delta, x.dims, AS_OF, **DONE).settled()[1] == kinds
