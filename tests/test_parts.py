"""Partitioned tables behind a manifest, and row orders that let readers skip."""

import datetime as dt
import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from workmill.operators import scd2
from workmill.session import configure
from workmill.sources import layout, tables
from workmill.sources.dimension import DimensionTable
from workmill.sources.parts import Conflict, Parts
from workmill.sources.profile import Profile
from workmill.streaming.incremental import NewestTable

DAY = dt.date


def logs(spark, months=6, per_month=20):
    rows = [(m * 100 + i, dt.datetime(2024, m, 1 + i % 28, 8), i) for m in range(1, months + 1) for i in range(per_month)]
    df = spark.createDataFrame(rows, "log_id int, start_time timestamp_ntz, n int")
    return tables.month_partition(df, "start_time")


def ids(df):
    return sorted(r[0] for r in df.select("log_id").collect())


def written(path) -> int:
    """Bytes of data files below a folder."""
    return sum(os.path.getsize(p) for p in Path(path).rglob("part-*.parquet"))


def test_commit_replaces_appends_and_drops(spark, tmp_path):
    table = Parts(spark, f"{tmp_path}/t", "month")
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(logs(spark, 3), note={"top": 1})
    table.commit(logs(spark, 1).withColumn("log_id", F.lit(1)).limit(1), replaced=[DAY(2024, 1, 1), DAY(2024, 2, 1)])
    assert ids(table.read()) == [1, *range(300, 320)]
    table.commit(logs(spark, 3).filter("log_id >= 300").limit(1))
    assert table.read().count() == 22 and table.note() == {"top": 1}
    assert {n: len(v) for n, v in table.parts().items()} == {"month=2024-01-01": 1, "month=2024-03-01": 2}
    assert ids(table.read(only=[DAY(2024, 1, 1)])) == [1]
    assert table.compact(most=1) == ["month=2024-03-01"] and table.read().count() == 22
    assert table.drop(lambda name: name < "month=2024-02") == ["month=2024-01-01"]
    assert table.read().count() == 21 and table.read(number=1).count() == 60
    # Rows without a partition value have a partition, which can be emptied.
    table.commit(logs(spark, 1).limit(2).withColumn("month", F.lit(None).cast("date")))
    assert table.read().filter("month IS NULL").count() == 2
    table.commit(logs(spark, 1).limit(1), replaced=[None, DAY(2024, 3, 1)])
    assert table.read().count() == 1
    assert table.prune(keep=1) > 0 and table.read().count() == 1
    assert len(list(Path(f"{tmp_path}/t/data").iterdir())) == 1


def test_a_load_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = Parts(spark, f"{tmp_path}/t", "month")
    table.commit(logs(spark, 3))
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            table.commit(logs(spark, 2).withColumn("n", F.lit(-1)), replaced=[DAY(2024, 1, 1), DAY(2024, 2, 1)])
    assert table.read().filter("n < 0").count() == 0 and table.read().count() == 60
    # A write that fails between two months is as invisible.
    broken = logs(spark, 2).withColumn("n", F.when(F.col("month") > "2024-01-15", F.raise_error(F.lit("lost")).cast("int")).otherwise(-1))
    with pytest.raises(Exception, match="lost"):
        table.commit(broken, replaced=[DAY(2024, 1, 1), DAY(2024, 2, 1)])
    assert table.read().filter("n < 0").count() == 0 and table.read().count() == 60
    table.commit(logs(spark, 1).withColumn("n", F.lit(-1)), replaced=[DAY(2024, 1, 1)])
    assert table.read().filter("n < 0").count() == 20 and table.read().count() == 60


def test_two_writers_cannot_both_commit(spark, tmp_path, monkeypatch):
    table, other = (Parts(spark, f"{tmp_path}/t", "month") for _ in range(2))
    table.commit(logs(spark, 1))
    seen = other._manifest()
    table.commit(logs(spark, 2).filter("log_id >= 200"))
    monkeypatch.setattr(other, "_manifest", lambda number=None: seen)
    with pytest.raises(Conflict):
        other.commit(logs(spark, 1).withColumn("n", F.lit(-1)))
    assert table.read().count() == 40 and table.read().filter("n < 0").count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_ranges_and_calendars_prune_months(spark, tmp_path):
    table = Parts(spark, f"{tmp_path}/t", "month")
    table.commit(logs(spark, 6))
    some = tables.in_months(table.read(), "start_time", "2024-02-10", "2024-04-01")
    assert ids(some) == ids(logs(spark).filter("start_time >= '2024-02-10' AND start_time < '2024-04-01'"))
    text = plan(some)
    assert "PartitionFilters: [isnotnull(month" in text and "month#" in text.split("PartitionFilters")[1][:160]
    assert len(some.inputFiles()) == len(table.read().inputFiles())  # before pruning; the scan below opens two months
    assert {f.split("month=")[1][:7] for f in [r[0] for r in some.select(F.input_file_name()).distinct().collect()]} == {"2024-02", "2024-03"}
    kept = tables.retention(table.read(), "start_time", 30, "2024-06-20", "month")
    assert ids(kept) == ids(logs(spark).filter("start_time >= '2024-05-21'")) and "2024-05-01" in plan(kept).split("PartitionFilters")[1][:200]
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS full_date").withColumn("quarter", F.quarter("full_date"))
    spring = tables.in_calendar(table.read(), days.filter("quarter = 2"))
    assert ids(spring) == ids(logs(spark).filter("start_time >= '2024-04-01' AND start_time < '2024-07-01'"))
    assert "dynamicpruning" in plan(spring)
    gone = table.drop(tables.expired("month", 30, "2024-06-20"))
    assert gone == [f"month=2024-0{m}-01" for m in range(1, 5)]


def groups_read(folder, **ranges) -> tuple[int, int]:
    """Row groups whose statistics meet the ranges, and all of them."""
    hit = total = 0
    for file in Path(folder).rglob("part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            hit += all(stats[c].max >= low and stats[c].min <= high for c, (low, high) in ranges.items())
    return hit, total


def test_sorted_layouts_let_readers_skip(spark, tmp_path, conf=None):
    rows = spark.range(40_000).select(F.col("id"), (F.hash("id") % 1000).alias("a"), (F.hash("id", F.lit(1)) % 1000).alias("b"))
    orders = {
        "plain": rows.repartition(16),
        "clustered": layout.clustered(rows, ["a"], files=16),
        "filling": layout.space_filling(rows, ["a", "b"], files=16),
    }
    hits = {}
    for name, df in orders.items():
        df.write.option("parquet.block.size", 1 << 13).parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.count() == 40_000 and back.agg(F.sum("id")).first()[0] == 40_000 * 39_999 // 2
        a, total = groups_read(f"{tmp_path}/{name}", a=(100, 150))
        b, _ = groups_read(f"{tmp_path}/{name}", b=(100, 150))
        hits[name] = (a / total, b / total)
    assert hits["plain"] == (1.0, 1.0)
    assert hits["clustered"][0] < 0.2 and hits["clustered"][1] == 1.0
    assert max(hits["filling"]) < 0.5
    within = layout.sorted_within(rows.withColumn("p", F.col("id") % 3), ["p"], ["a"])
    assert "RebalancePartitions" in within._jdf.queryExecution().optimizedPlan().toString()


def test_space_filling_takes_missing_and_equal_keys(spark, tmp_path):
    rows = spark.sql("SELECT id, if(id % 3 = 0, null, 7) AS a, timestamp_ntz'2024-01-01' + make_dt_interval(id % 5) AS t FROM range(300)")
    layout.space_filling(rows, ["a", "t"], files=3).write.parquet(f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").exceptAll(rows).count() == 0
    empty = layout.space_filling(rows.filter("id < 0"), ["a", "t"])
    assert empty.count() == 0


def users(spark, n, renamed=()):
    rows = [(f"u{i}", f"{i}@x", "F", "New" if i in renamed else "L", "member", "active") for i in n]
    return spark.createDataFrame(rows, "user_id string, email string, first_name string, last_name string, role string, status string")


def test_dimension_writes_what_changed(spark, tmp_path):
    table = DimensionTable(spark, f"{tmp_path}/d", scd2.USERS, buckets=16)
    data = f"{tmp_path}/d/data"
    assert table.load(users(spark, range(4000)), "2024-01-01", "B1")["new"] == 4000
    whole = written(data)
    kinds = table.load(users(spark, range(4000), renamed=[7]), "2024-01-02", "B2")
    assert (kinds["changed"], kinds["unchanged"]) == (1, 3999)
    first = written(data) - whole
    assert first < whole / 8
    # New keys are appended: no bucket is written again.
    assert table.load(users(spark, range(4001), renamed=[7]), "2024-01-03", "B3")["new"] == 1
    assert written(data) - whole - first < whole / 20
    before = written(data)
    assert table.load(users(spark, range(4001), renamed=[7]), "2024-01-04", "B4")["unchanged"] == 4001
    assert written(data) == before
    # Row for row what the merge as one query gives.
    src = users(spark, range(2, 4001), renamed=[7, 8, 9])
    stored = table.read()
    expected = scd2.scd2_merge(stored, src, scd2.USERS, "2024-01-05", "B5")
    kinds = table.load(src, "2024-01-05", "B5")
    assert (kinds["deleted"], kinds["changed"]) == (2, 2)
    assert table.read().drop("user_key").exceptAll(expected.drop("user_key")).count() == 0 and table.read().count() == expected.count()
    keys = [r[0] for r in table.read().select("user_key").collect()]
    assert len(keys) == len(set(keys)) == max(keys)
    assert table.current().count() == 3999 and scd2.scd2_problems(table.read(), "user_id").count() == 0
    old = {r["user_id"] for r in table.read().filter("NOT is_current").collect()}
    assert old == {"u0", "u1", "u7", "u8", "u9"}
    assert table.load(users(spark, range(4001), renamed=[7, 8, 9]), "2024-01-06", "B6", reopen=True)["returned"] == 2
    table.prune(1)
    assert table.current().count() == 4001


def test_newest_rows_by_bucket(spark, tmp_path):
    table = NewestTable(spark, f"{tmp_path}/n", "k", ["ts"], buckets=16)
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("ts"), F.lit("x" * 50).alias("v"))
    assert table.upsert(rows) == 4000
    data = f"{tmp_path}/n/data"
    whole = written(data)
    late = rows.filter("k < 10").withColumn("ts", F.lit(0))
    few = rows.filter("k = 5 OR k = 6").withColumns({"ts": F.lit(2), "v": F.lit("new")})
    assert table.upsert(late.unionByName(few)) == 2
    grown = written(data)
    assert 0 < grown - whole < whole / 4
    version = table.parts._numbers()[-1]
    assert table.upsert(late.unionByName(few)) == 0 and table.parts._numbers()[-1] == version
    assert table.upsert(spark.createDataFrame([(None, 3, "null key"), (9000, 1, "new")], "k long, ts int, v string")) == 2
    assert table.upsert(spark.createDataFrame([(None, 2, "older"), (None, 4, "newer")], "k long, ts int, v string")) == 1
    got = {r["k"]: (r["ts"], r["v"]) for r in table.read().collect()}
    assert len(got) == 4002 and got[5] == (2, "new") and got[None] == (4, "newer") and got[7][0] == 1


def test_profile_reads_each_load_once(spark, tmp_path):
    table = Parts(spark, f"{tmp_path}/t", "month")
    profile = Profile(spark, f"{tmp_path}/p", table)
    table.commit(logs(spark, 3))
    first = profile.refresh()
    assert len(first) == 1 and profile.refresh() == []
    table.commit(logs(spark, 6).filter("log_id >= 400").withColumn("n", F.when(F.col("n") > 0, F.col("n"))))
    second = profile.refresh()
    assert len(second) == 1 and second != first
    rows = {r["column_name"]: r for r in profile.read().collect()}
    n = rows["n"]
    assert (n["row_count"], n["null_count"], n["min_value"], n["max_value"]) == (120, 3, "0", "19")
    assert abs(n["distinct_estimate"] - 20) <= 1 and 8 <= n["quantiles"][1] <= 12
    assert rows["start_time"]["min_value"] == "2024-01-01 08:00:00" and rows["log_id"]["distinct_estimate"] in range(115, 126)
    # A month written anew: its old load is read again without it, the new one is added.
    table.commit(logs(spark, 1).withColumn("n", F.lit(1000)), replaced=[DAY(2024, 1, 1)])
    assert len(profile.refresh()) == 2
    after = {r["column_name"]: r for r in profile.read().collect()}["n"]
    assert (after["row_count"], after["max_value"]) == (120, "1000")
    table.drop(lambda name: True)
    assert profile.refresh() == [] and {r["row_count"] for r in profile.read().collect()} in ({None}, set())


def test_tasks_get_small_shares_unless_the_cluster_names_a_size(spark):
    name, session = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.newSession()
    session.conf.unset(name)
    configure(session)
    # Rows that are joined and grouped lie in a task unpacked, several times over.
    assert session.conf.get(name) == "16m"
    session.conf.set(name, "1m")
    configure(session)
    assert session.conf.get(name) == "1m"
