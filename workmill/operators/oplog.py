"""Batch, error and audit logs of loads.

Logs are append-only parquet: the start and the end of a batch are two rows
that a read folds into one. Appends do not depend on the data write they
describe, so a failed load still leaves its rows. Times are wall-clock.
"""

from __future__ import annotations

import json
import secrets
import uuid
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.functions.moments import seconds_between
from workmill.sources.schemas import schema
from workmill.sources.tables import append_row

COUNTERS = ("records_processed", "records_inserted", "records_updated", "records_failed")


class UnknownBatch(LookupError):
    pass


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_batch_id(moment: datetime | None = None) -> str:
    return f"BATCH-{moment or now():%Y%m%d-%H%M%S}-{secrets.token_hex(4)}"


def batch_id_column(moment: Column, seed: Column) -> Column:
    """The same form of id as a column, the tail drawn from `seed`."""
    return F.concat(
        F.lit("BATCH-"), F.date_format(moment, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.md5(seed.cast("string")), 1, 8)
    )


def fold_batches(events: DataFrame) -> DataFrame:
    """One row per batch from its start and end rows.

    A counter is the last non-NULL one; status and message are those of the
    last row even where the message is NULL. An end row comes after a start row
    whatever their clocks say. Aggregates only: combined before the shuffle,
    whatever the number of rows of one batch.
    """

    def last(c: str, only_set: bool = False) -> Column:
        seq = F.col("seq")
        return F.max_by(c, F.when(F.col(c).isNotNull(), seq) if only_set else seq).alias(c)

    rows = events.withColumn("seq", F.struct(F.col("batch_end_time").isNotNull(), F.coalesce("batch_end_time", "batch_start_time")))
    sums = [c for c in COUNTERS if c in events.columns]
    # max_by ignores rows whose ordering value is NULL.
    return rows.groupBy("batch_id").agg(
        F.min("batch_start_time").alias("batch_start_time"),
        F.max("batch_end_time").alias("batch_end_time"),
        last("status"),
        last("source_system", True),
        *[last(c, True) for c in sums],
        last("error_message"),
        *[last(c, True) for c in ("created_by", "parent_batch_id", "details") if c in events.columns],
    )


def execution_seconds(start: Column, end: Column) -> Column:
    """DECIMAL(10,2) seconds; NULL where a bound is NULL."""
    return seconds_between(start, end).cast("decimal(10,2)")


def audit_rows(runs: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows for a table of finished or running steps: the end defaults to
    `as_of`, while the duration stays NULL for a step without an end."""
    return runs.select(
        "batch_id",
        "table_name",
        "operation_type",
        "records_affected",
        "start_time",
        F.coalesce("end_time", as_of).alias("end_time"),
        "status",
        execution_seconds(F.col("start_time"), F.col("end_time")).alias("execution_time_seconds"),
    )


class LoadLog:
    """The three control tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._started: set[str] = set()

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _append(self, name: str, **values) -> None:
        append_row(self.spark, self._path(name), schema(name), **values)

    def start(self, source_system: str, created_by: str = "ETL_PROCESS", parent: str | None = None) -> str:
        moment = now()
        batch_id = new_batch_id(moment)
        self._append(
            "etl_batch_log",
            batch_id=batch_id,
            batch_start_time=moment,
            status="RUNNING",
            source_system=source_system,
            created_by=created_by,
            created_timestamp=moment,
            parent_batch_id=parent,
        )
        self._started.add(batch_id)
        return batch_id

    def end(self, batch_id: str, status: str, error: str | None = None, details: dict | None = None, **counters) -> None:
        if not self._known(batch_id):
            raise UnknownBatch(f"the log has no batch {batch_id}")
        self._append(
            "etl_batch_log",
            batch_id=batch_id,
            batch_end_time=now(),
            status=status,
            error_message=error,
            details=json.dumps(details) if details is not None else None,
            **{f"records_{k}": v for k, v in counters.items()},
        )

    def _known(self, batch_id: str) -> bool:
        if batch_id in self._started:
            return True
        try:
            rows = self.spark.read.schema(schema("etl_batch_log")).parquet(self._path("etl_batch_log"))
        except Exception as problem:  # noqa: BLE001 - a log not written yet
            if "PATH_NOT_FOUND" in str(problem):
                return False
            raise
        return not rows.filter(F.col("batch_id") == batch_id).isEmpty()

    def error(
        self, batch_id: str, severity: str, code: str, message: str, table: str | None = None, key: str | None = None, data: dict | None = None
    ) -> str:
        error_id = str(uuid.uuid4())
        self._append(
            "etl_error_log",
            error_id=error_id,
            batch_id=batch_id,
            error_timestamp=now(),
            error_severity=severity,
            error_code=code,
            error_message=message,
            source_table=table,
            source_key=key,
            error_data=json.dumps(data) if data is not None else None,
            resolved=False,
        )
        return error_id

    def audit(
        self,
        batch_id: str,
        table: str,
        operation: str,
        status: str,
        records: int | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
        error: str | None = None,
        details: dict | None = None,
    ) -> str:
        audit_id = str(uuid.uuid4())
        took = None
        if start is not None and end is not None:
            took = Decimal(str((end - start).total_seconds())).quantize(Decimal("0.01"), ROUND_HALF_UP)
        self._append(
            "etl_audit_log",
            audit_id=audit_id,
            batch_id=batch_id,
            table_name=table,
            operation_type=operation,
            records_affected=records,
            start_time=start or now(),
            end_time=end or now(),
            status=status,
            error_message=error,
            execution_time_seconds=took,
            details=json.dumps(details) if details is not None else None,
        )
        return audit_id

    def batches(self) -> DataFrame:
        return fold_batches(self.spark.read.schema(schema("etl_batch_log")).parquet(self._path("etl_batch_log")))

    def errors(self) -> DataFrame:
        return self.spark.read.schema(schema("etl_error_log")).parquet(self._path("etl_error_log"))

    def audits(self) -> DataFrame:
        return self.spark.read.schema(schema("etl_audit_log")).parquet(self._path("etl_audit_log"))
