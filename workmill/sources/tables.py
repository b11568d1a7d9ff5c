"""Reading and writing parquet tables, and the layouts they are written in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from workmill.functions.moments import at, month_of, on, parse
from workmill.sources import schemas


# -- reading and writing ------------------------------------------------------


def read(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Scan one table with its declared schema (no inference pass)."""
    return spark.read.schema(schema or schemas.schema(name)).parquet(f"{root}/{name}")


def balanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Gather rows of a partition value into few files, splitting a hot value
    over several tasks: AQE sizes both at run time."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    balanced(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def append_row(spark: SparkSession, path: str, schema: StructType, **values) -> None:
    """Insert one row; missing columns are NULL and ids come from the caller."""

    def literal(value) -> Column:
        return at(value) if isinstance(value, datetime) else F.lit(value)

    row = [literal(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(0, 1, 1, 1).select(*row).write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Truncate and reload. `df` must not read from `path`; see `Versions`."""
    balanced(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions `df` has rows for; the rest stay as they are.

    A frame that reads this table must be cut first (`session.cut`).
    """
    (
        balanced(df, partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


class Versions:
    """A table rewritten whole: each write is a new directory.

    A version counts only once its job committed (`_SUCCESS`), so readers never
    see half a write and a rewrite may read the version it replaces.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _complete(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name[2:]))
        return sorted(done)

    def exists(self) -> bool:
        return bool(self._complete())

    def read(self, version: int | None = None) -> DataFrame:
        number = self._complete()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/v={number}")

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest `keep` complete versions; keep as many as
        readers may still be using."""
        jvm = self.spark._jvm
        for number in self._complete()[:-keep]:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={number}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        done = self._complete()
        number = done[-1] + 1 if done else 1
        overwrite(df, f"{self.path}/v={number}", partition_by)
        return number


# -- columns filled at write time -------------------------------------------


def with_generated(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Stored generated columns: always computed, whatever the input holds."""
    return df.withColumns(dict(columns))


def with_defaults(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Fill columns that are absent; an explicit NULL stays NULL."""
    missing = {n: c for n, c in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def touch(df: DataFrame, was_changed: Column, as_of) -> DataFrame:
    """Set updated_at on changed rows."""
    return df.withColumn("updated_at", F.when(was_changed, at(as_of)).otherwise(F.col("updated_at")))


# -- layout -------------------------------------------------------------------


def hash_partition(df: DataFrame, col: str, n: int = 4) -> DataFrame:
    """Add `bucket` = hash of `col` modulo n, for use as a partition column.

    One tenant lands in one bucket. When one tenant dominates, write with
    `bucketBy` on a finer key instead (`save_bucketed`).
    """
    return df.withColumn("bucket", F.pmod(F.hash(col), F.lit(n)))


def save_bucketed(df: DataFrame, table: str, key: str, n: int, sort: Sequence[str] = ()) -> None:
    """Save as a catalog table bucketed on `key`; joins of two such tables on
    `key` with equal `n` need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(n, key)
    if sort:
        writer = writer.sortBy(*sort)
    writer.saveAsTable(table)


def month_partition(df: DataFrame, ts: str, name: str = "month") -> DataFrame:
    return df.withColumn(name, month_of(F.col(ts)))


def in_months(df: DataFrame, ts: str, start=None, end=None, name: str = "month") -> DataFrame:
    """Rows with `start` <= ts < `end` (either may be open), of the month
    directories that can hold any.

    Catalyst does not derive the month predicate from the timestamp, so both
    are stated: months from that of `start` to that of the last moment before
    `end`. Where a stored table has no column `name`, only the time counts.
    """
    out = df
    if start is not None:
        out = out.filter(F.col(ts) >= at(start))
        if name in df.columns:
            out = out.filter(F.col(name) >= on(parse(start).replace(day=1)))
    if end is not None:
        out = out.filter(F.col(ts) < at(end))
        if name in df.columns:
            out = out.filter(F.col(name) <= on((parse(end) - timedelta(microseconds=1)).replace(day=1)))
    return out


def in_calendar(df: DataFrame, calendar: DataFrame, name: str = "month") -> DataFrame:
    """Rows of the months in which `calendar` (rows of the date dimension) has a day.

    The months are known only at run time: a semi join on the partition column,
    from which Spark prunes directories once the calendar side is read.
    """
    months = calendar.select(F.trunc("full_date", "MM").alias("__month")).distinct()
    return df.join(F.broadcast(months), F.col(name) == F.col("__month"), "left_semi")


def quarter_partition(df: DataFrame, ts: str, name: str = "part") -> DataFrame:
    """Add `tasks_<year>_q<n>`; rows without a date go to `tasks_no_date`."""
    label = F.concat(
        F.lit("tasks_"), F.year(ts).cast("string"), F.lit("_q"), F.quarter(ts).cast("string")
    )
    return df.withColumn(name, F.coalesce(label, F.lit("tasks_no_date")))


def month_calendar(spark: SparkSession, as_of, months: int = 12, table: str = "time_logs", version: int = 1) -> DataFrame:
    """Expected monthly partitions: the month of `as_of` and the ones after."""
    pattern = {1: ("_y", "yyyy'm'MM"), 2: ("_", "yyyy_MM")}[version]
    first = F.trunc(on(as_of), "MM")
    days = spark.range(1).select(
        F.explode(F.sequence(first, F.add_months(first, months - 1), F.expr("INTERVAL 1 MONTH"))).alias("starts")
    )
    return days.select(
        F.concat(F.lit(table + pattern[0]), F.date_format("starts", pattern[1])).alias("partition_name"),
        "starts",
        F.add_months("starts", 1).alias("ends"),
    )


def quarter_calendar(spark: SparkSession, as_of) -> DataFrame:
    """Expected task partitions: the eight quarters of this year and the next."""
    first = F.trunc(on(as_of), "YEAR")
    days = spark.range(1).select(
        F.explode(F.sequence(first, F.add_months(first, 21), F.expr("INTERVAL 3 MONTH"))).alias("starts")
    )
    name = F.concat(F.lit("tasks_"), F.year("starts").cast("string"), F.lit("_q"), F.quarter("starts").cast("string"))
    return days.select(name.alias("partition_name"), "starts", F.add_months("starts", 3).alias("ends"))


def partition_coverage(calendar: DataFrame, df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Each expected partition with the rows that already fall into it.

    Rows are counted per period before the join, so it sees one row per period.
    """
    held = df.groupBy(F.trunc(F.to_date(ts), unit).alias("starts")).agg(F.count(F.lit(1)).alias("row_count"))
    return (
        calendar.join(held, "starts", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("is_missing", F.col("row_count") == 0)
    )


# -- profile, retention, soft delete ---------------------------------------------


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: rows, NULLs, distinct values, smallest and largest.

    One aggregation over the table with distinct counts from a sketch. With
    `exact=True` a second pass counts them from (column, value) pairs, which
    are made unique before and after the shuffle; it moves every distinct value
    of every column.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"nulls{i}"),
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
        ]
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"distinct{i}"))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("row_count"),
            F.col(f"nulls{i}").alias("null_count"),
            *([] if exact else [F.col(f"distinct{i}").alias("distinct_count")]),
            F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
        )
        for i, c in enumerate(df.columns)
    ]
    profile = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if not exact:
        return profile
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("v")) for c in df.columns])
    values = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct()
    counts = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return profile.join(counts, "column_name", "left").select(
        "column_name",
        "row_count",
        "null_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        "min_value",
        "max_value",
    )


def _text(df: DataFrame, c: str) -> Column:
    """A text that differs where the values differ."""
    kind = df.schema[c].dataType.typeName()
    if kind == "binary":
        return F.hex(c)
    return F.to_json(c) if kind in ("array", "struct", "map") else F.col(c).cast("string")


def retention(df: DataFrame, ts: str, days: int, as_of, month: str | None = None) -> DataFrame:
    """Keep rows of the last `days` days. With `month`, the partition column of
    a table stored by month, directories before the first kept month are not
    listed; `Parts.drop` with `expired` removes them from such a table."""
    return in_months(df, ts, parse(as_of) - timedelta(days=days), None, month or "")


def expired(part: str, days: int, as_of):
    """A test of directory names: months that end before the last `days` days."""
    first = f"{part}={(parse(as_of) - timedelta(days=days)).replace(day=1):%Y-%m-%d}"
    return lambda name: name.startswith(f"{part}=") and name < first and name != f"{part}=__HIVE_DEFAULT_PARTITION__"


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())
