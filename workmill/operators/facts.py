"""Fact and bridge loads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from workmill.functions.keys import fill_keys
from workmill.functions.measures import task_measures
from workmill.functions.moments import at, minutes_between
from workmill.functions.scalars import amount, any_distinct, distinct_from
from workmill.operators.lookup import UNKNOWN, current, date_lookup, lookup, lookup_as_of
from workmill.session import broadcastable, cut
from workmill.sources.schemas import schema

# The columns whose change makes a stored task fact stale.
TRACKED = ("title", "description", "status_key", "priority_key", "due_date_key", "completed_date_key")
LOG_TRACKED = ("task_key", "user_key", "start_timestamp", "end_timestamp", "is_billable", "billing_rate", "description")


@dataclass(frozen=True)
class Dims:
    users: DataFrame
    projects: DataFrame
    status: DataFrame
    priority: DataFrame
    time: DataFrame


def _with_people(tasks: DataFrame, users: DataFrame, valid_at: str | None) -> DataFrame:
    """Add assigned_to_key and reporter_key.

    With few users both lookups are broadcasts and nothing moves. Otherwise
    each lookup shuffles its left side; then only the ids go through them and
    come back by all the columns they depend on, so that whole task rows (title,
    description, labels) shuffle once here. The task id is among those columns to
    spread a user with very many tasks; it need not be unique or present.
    """

    def keys(rows: DataFrame) -> DataFrame:
        rows = _find(rows, users, "assigned_to", "user_id", {"assigned_to_key": "user_key"}, valid_at)
        return _find(rows, users, "reporter_id", "user_id", {"reporter_key": "user_key"}, valid_at)

    if broadcastable(users):
        return keys(tasks)
    by = ["task_id", "assigned_to", "reporter_id", *([valid_at] if valid_at else [])]
    people = keys(tasks.select(*by).distinct()).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & tasks[c].eqNullSafe(people[f"__{c}"])
    return tasks.join(people, same, "left").drop(*[f"__{c}" for c in by])


def _find(
    rows: DataFrame, dim: DataFrame, on: str, key: str, take: Mapping[str, str], valid_at: str | None, nullable: bool = True
) -> DataFrame:
    """The current version's columns, or those of the version valid at a time."""
    if valid_at is None:
        return lookup(rows, current(dim), on, key, take, by="task_id", nullable=nullable)
    return lookup_as_of(rows, dim, on, valid_at, key, take)


def resolve_tasks(
    tasks: DataFrame, dims: Dims, as_of, batch_id: str | None = None, valid_at: str | None = None, **statuses
) -> DataFrame:
    """Source tasks as fact rows (no surrogate): keys looked up, measures derived.

    Keys are those of the current dimension versions, or with `valid_at` (a
    timestamp column such as created_at) of the versions valid then. A key that
    finds no row is NULL, except the due and completed dates, which get -1.
    """
    optional = {
        "description": "string",
        "block_reason": "string",
        "task_type": "string",
        "labels": "array<string>",
        "updated_at": "timestamp_ntz",
    }
    missing = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in tasks.columns}
    rows = tasks.withColumns(missing) if missing else tasks
    rows = _find(rows, dims.status, "status", "status_id", {"status_key": "status_key"}, valid_at, nullable=False)
    rows = _find(rows, dims.priority, "priority", "priority_id", {"priority_key": "priority_key"}, valid_at, nullable=False)
    rows = date_lookup(rows, dims.time, "created_at", "created_date_key")
    rows = date_lookup(rows, dims.time, "due_date", "due_date_key", unknown=True)
    rows = date_lookup(rows, dims.time, "completed_at", "completed_date_key", unknown=True)
    rows = _find(rows, dims.projects, "project_id", "project_id", {"project_key": "project_key"}, valid_at)
    rows = _with_people(rows, dims.users, valid_at)
    computed = {
        **task_measures(as_of, **statuses),
        "created_timestamp": F.col("created_at"),
        "updated_timestamp": F.col("updated_at"),
        "etl_batch_id": F.lit(batch_id).cast("string"),
        "etl_timestamp": at(as_of),
    }
    names = [f.name for f in schema("fact_tasks") if f.name != "task_key"]
    tenant = ["organization_id"] if "organization_id" in tasks.columns else []
    return rows.select(*[computed[n].alias(n) if n in computed else n for n in names], *tenant)


@dataclass(frozen=True)
class FactLoad:
    """Incoming rows marked new, changed or unchanged against a stored fact."""

    fact: DataFrame
    classified: DataFrame
    key: str
    surrogate: str

    def of(self, *kinds: str) -> DataFrame:
        return self.classified.filter(F.col("kind").isin(*kinds)).drop("kind")

    def counts(self) -> DataFrame:
        return self.classified.groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"))

    def settled(self) -> tuple[FactLoad, dict[str, int]]:
        """Write the new and changed rows once (an action); returns the load
        resting on them and the rows per kind.

        The counts are observed while the rows are written, in the tasks that
        write them, so they need no pass of their own and a retried task is
        counted once.
        """
        seen = Observation()
        kinds = ("new", "changed", "unchanged")
        watched = self.classified.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
        delta = cut(watched.filter(F.col("kind") != "unchanged"))
        return FactLoad(self.fact, delta, self.key, self.surrogate), seen.get

    def merged(self) -> DataFrame:
        """The whole fact after the load; new rows have a NULL surrogate.

        Stored rows that stay are kept by an anti join on the keys of the
        changed ones, which AQE broadcasts when few changed; the stored table
        is then not shuffled at all.
        """
        target = self.fact.columns
        changed_keys = self.of("changed").select(self.key)
        stays = self.fact.join(changed_keys, self.key, "left_anti")
        return stays.unionByName(self.of("new", "changed").select(*target))

    def keyed(self) -> DataFrame:
        """`merged` with surrogates for the new rows (runs jobs)."""
        return fill_keys(self.merged(), self.surrogate, [self.key])


def classify(
    fact: DataFrame,
    incoming: DataFrame,
    key: str,
    surrogate: str,
    tracked: Sequence[str],
    ids: DataFrame | None = None,
    part: str | None = None,
) -> FactLoad:
    """Compare incoming rows with the stored ones on the tracked columns.

    Only the key, the surrogate and the tracked columns of the stored table
    take part, so the scan and the shuffle of the fact stay narrow. `ids` holds
    the incoming keys in one column; where they are few enough to broadcast,
    the stored rows are reduced to them before the join and the fact is not
    shuffled at all. `part` is a column of the stored rows that comes along as
    `stored_part`.
    """
    stored = fact.select(
        F.col(key).alias("__key"),
        F.col(surrogate).alias("__surrogate"),
        *[F.col(c).alias(f"__old_{c}") for c in tracked],
        *([F.col(part).alias("stored_part")] if part else []),
    )
    if ids is not None and broadcastable(ids):
        wanted = ids.select(F.col(ids.columns[0]).alias("__wanted"))
        stored = stored.join(wanted, F.col("__key") == F.col("__wanted"), "left_semi")
    differs = any_distinct((F.col(f"__old_{c}"), F.col(c)) for c in tracked)
    kind = F.when(F.col("__key").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    rows = incoming.join(stored, F.col(key) == F.col("__key"), "left").withColumns(
        {"kind": kind, surrogate: F.col("__surrogate")}
    )
    helper = [c for c in rows.columns if c.startswith("__")]
    return FactLoad(fact, rows.drop(*helper), key, surrogate)


def load_fact_tasks(
    fact: DataFrame,
    tasks: DataFrame,
    dims: Dims,
    as_of,
    batch_id: str | None = None,
    tracked: Sequence[str] = TRACKED,
    **statuses,
) -> FactLoad:
    """One incremental load: the lookups run once and serve update and insert.

    By default a stored row whose tracked columns are equal keeps its old day
    counts; pass more columns in `tracked` to refresh on them too.
    """
    incoming = resolve_tasks(tasks, dims, as_of, batch_id, **statuses)
    return classify(fact, incoming, "task_id", "task_key", tracked, tasks.select("task_id"))


def touched_partitions(load: FactLoad, part: str) -> list:
    """Partition values a load writes to: at most one per month of data."""
    moved = load.fact.join(load.of("changed").select(load.key), load.key, "left_semi").select(part)
    rows = load.of("new", "changed").select(part).union(moved).distinct().collect()
    return [r[0] for r in rows]


def rewritten_partitions(load: FactLoad, part: str) -> list:
    """Partitions that hold the stored form of a changed row; rows of all
    others only need adding."""
    moved = load.fact.join(load.of("changed").select(load.key), load.key, "left_semi")
    return [r[0] for r in moved.select(part).distinct().collect()]


def load_fact_time_logs(
    logs: DataFrame, fact_tasks: DataFrame, users: DataFrame, time: DataFrame, batch_id: str | None = None, as_of=None
) -> DataFrame:
    """Time logs as fact rows (definitions are ours; only the table is given)."""
    return with_log_measures(keyed_time_logs(logs, fact_tasks, users), time, batch_id, as_of)


def keyed_time_logs(
    logs: DataFrame, fact_tasks: DataFrame, users: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """The columns of a time log that do not follow from others, with keys: what
    is worth shuffling. Task and project come from the task fact, the user from
    the current user version. `settle` gets the rows between the two lookups."""
    optional = {"log_id": "string", "description": "string"}
    missing = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in logs.columns}
    rows = logs.withColumns(missing) if missing else logs
    task = {"task_key": "task_key", "project_key": "project_key"}
    rows = lookup(rows, fact_tasks, "task_id", "task_id", task, nullable=False)
    tenant = [c for c in ("organization_id",) if c in logs.columns]
    rows = settle(
        rows.select(
            F.col("log_id").alias("time_log_id"),
            "user_id",
            "task_key",
            "project_key",
            F.col("start_time").alias("start_timestamp"),
            F.col("end_time").alias("end_timestamp"),
            amount(F.col("hourly_rate"), 15, 2).alias("billing_rate"),
            F.coalesce("billable", F.lit(False)).alias("is_billable"),
            "description",
            *tenant,
        )
    )
    rows = lookup(rows, current(users), "user_id", "user_id", {"user_key": "user_key"}, nullable=False)
    return rows.select("time_log_id", "task_key", "user_key", "project_key", "start_timestamp", "end_timestamp", "billing_rate", "is_billable", "description", *tenant)


def with_log_measures(logs: DataFrame, time: DataFrame, batch_id: str | None = None, as_of=None, also: Sequence[str] = ()) -> DataFrame:
    """Keyed time logs with all columns of the fact, and those of `also`.

    Minutes are the source's whole minutes; a log still running has 0. Hours
    are minutes / 60, billable hours are the hours of billable logs, and the
    amount is billable hours times the hourly rate.
    """
    rows = date_lookup(logs, time, "start_timestamp", "date_key")
    rows = date_lookup(rows, time, "end_timestamp", "end_time_key")
    minutes = amount(F.coalesce(minutes_between(F.col("start_timestamp"), F.col("end_timestamp")), F.lit(0)))
    rows = rows.withColumn("duration_minutes", minutes)
    rows = rows.withColumn("duration_hours", amount(F.col("duration_minutes") / F.lit(60)))
    rows = rows.withColumn("billable_hours", F.when(F.col("is_billable"), F.col("duration_hours")).otherwise(amount(F.lit(0))))
    return rows.select(
        "time_log_id",
        "task_key",
        "user_key",
        "project_key",
        "date_key",
        F.col("date_key").alias("start_time_key"),
        "end_time_key",
        "start_timestamp",
        "end_timestamp",
        "duration_minutes",
        "duration_hours",
        "billable_hours",
        "billing_rate",
        amount(F.col("billable_hours") * F.col("billing_rate"), 15, 2).alias("billing_amount"),
        "is_billable",
        "description",
        F.lit(None).cast("string").alias("activity_type"),
        F.lit(None).cast("string").alias("approval_status"),
        F.lit(None).cast("int").alias("approved_by"),
        F.lit(None).cast("timestamp_ntz").alias("approval_timestamp"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        (F.lit(None).cast("timestamp_ntz") if as_of is None else at(as_of)).alias("etl_timestamp"),
        *[c for c in ("organization_id",) if c in logs.columns],
        *also,
    )


def load_bridge(
    assignments: DataFrame, tasks: DataFrame, fact_tasks: DataFrame, users: DataFrame, time: DataFrame, batch_id: str | None = None, as_of=None
) -> DataFrame:
    """Task/user pairs with keys; primary where the task names that assignee.

    Pairs whose task or user is not in the warehouse are left out, since both
    keys are the primary key of the bridge.
    """
    owner = tasks.select("task_id", F.col("assigned_to").alias("__owner"))
    rows = assignments.join(owner, "task_id", "left")
    tenant = [c for c in ("organization_id",) if c in fact_tasks.columns]
    rows = rows.drop(*tenant).join(fact_tasks.select("task_id", "task_key", *tenant), "task_id")
    rows = rows.join(current(users).select("user_id", "user_key"), "user_id")
    rows = date_lookup(rows, time, "assigned_at", "assignment_date_key")
    return rows.select(
        "task_key",
        "user_key",
        F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False)).alias("is_primary"),
        "assignment_date_key",
        F.col("assigned_at").alias("assignment_timestamp"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        (F.lit(None).cast("timestamp_ntz") if as_of is None else at(as_of)).alias("etl_timestamp"),
        *tenant,
    )


def task_history(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], as_of, carry: Sequence[str] = ()) -> DataFrame:
    """Field-level changes between two snapshots, in one pass over both.

    INSERT rows list the fields a new task has values in, DELETE rows those a
    gone task had, UPDATE rows those that differ null-safely. Columns in `carry`
    come along, from the newer snapshot that has the row. Values become text
    after the join, since most are shorter without.
    """
    a = old.select(F.col(key).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields], *[F.col(c).alias(f"__a_{c}") for c in carry])
    b = new.select(F.col(key).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields], *[F.col(c).alias(f"__b_{c}") for c in carry])
    pairs = a.join(b, F.col("__a") == F.col("__b"), "full")
    kind = F.when(F.col("__a").isNull(), "INSERT").when(F.col("__b").isNull(), "DELETE").otherwise("UPDATE")
    was, now = ({f: F.col(f"{side}_{f}").cast("string") for f in fields} for side in "ab")
    cells = F.array(
        *[
            F.when(
                distinct_from(was[f], now[f]),
                F.struct(F.lit(f).alias("field_changed"), was[f].alias("old_value"), now[f].alias("new_value")),
            )
            for f in fields
        ]
    )
    rows = pairs.select(
        F.coalesce("__a", "__b").alias(key),
        *[F.coalesce(f"__b_{c}", f"__a_{c}").alias(c) for c in carry],
        kind.alias("change_type"),
        F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("cell"),
    )
    return rows.select(key, *carry, "cell.*", "change_type", at(as_of).alias("changed_timestamp"))


# Columns of the task fact whose changes are kept.
HISTORY = (*TRACKED, "project_key", "assigned_to_key")


def fact_history(old: DataFrame, new: DataFrame, time: DataFrame, as_of, batch_id: str | None = None, fields: Sequence[str] = HISTORY) -> DataFrame:
    """Changes between two states of the task fact as rows of fact_task_history,
    without the surrogate. Who changed a row is not in the sources: NULL."""
    tenant = [c for c in ("organization_id",) if c in new.columns]
    rows = task_history(old, new, "task_id", fields, as_of, ["task_key", *tenant])
    rows = date_lookup(rows, time, "changed_timestamp", "changed_date_key")
    return rows.select(
        "task_key",
        F.lit(None).cast("int").alias("changed_by_key"),
        "changed_date_key",
        "changed_timestamp",
        "field_changed",
        "old_value",
        "new_value",
        "change_type",
        F.concat_ws(" ", F.initcap("change_type"), F.lit("of"), "field_changed").alias("change_description"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        at(as_of).alias("etl_timestamp"),
        *tenant,
    )


def history_from_audit(audit: DataFrame, fields: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Field-level changes read out of old/new JSON in the audit log."""
    change = {"CREATE": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE"}
    mapped = F.create_map(*[F.lit(x) for pair in change.items() for x in pair])
    rows = audit.filter(F.col("action").isin(*change))
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field_changed"),
                F.get_json_object("old_values", f"$.{f}").alias("old_value"),
                F.get_json_object("new_values", f"$.{f}").alias("new_value"),
            )
            for f in fields
        ]
    )
    differing = F.filter(cells, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    return rows.select(
        F.col("entity_id").alias("task_id"),
        F.col("user_id").alias("changed_by"),
        F.explode(differing).alias("cell"),
        mapped[F.col("action")].alias("change_type"),
        F.col("created_at").alias("changed_timestamp"),
    ).select("task_id", "changed_by", "cell.*", "change_type", "changed_timestamp")


def keyed_history(history: DataFrame, fact_tasks: DataFrame, users: DataFrame, time: DataFrame) -> DataFrame:
    """History rows with warehouse keys for task, user and day."""
    rows = lookup(history, fact_tasks, "task_id", "task_id", {"task_key": "task_key"}, nullable=False)
    if "changed_by" in history.columns:
        rows = lookup(rows, current(users), "changed_by", "user_id", {"changed_by_key": "user_key"})
    else:
        rows = rows.withColumn("changed_by_key", F.lit(None).cast("int"))
    rows = date_lookup(rows, time, "changed_timestamp", "changed_date_key")
    return rows.select(
        "task_key", "changed_by_key", "changed_date_key", "changed_timestamp", "field_changed", "old_value", "new_value", "change_type"
    )


__all__ = [
    "HISTORY",
    "LOG_TRACKED",
    "TRACKED",
    "UNKNOWN",
    "Dims",
    "FactLoad",
    "classify",
    "fact_history",
    "history_from_audit",
    "keyed_history",
    "keyed_time_logs",
    "load_bridge",
    "load_fact_tasks",
    "load_fact_time_logs",
    "resolve_tasks",
    "task_history",
    "rewritten_partitions",
    "touched_partitions",
    "with_log_measures",
]
