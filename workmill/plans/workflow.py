"""The full load: dimensions, then facts, then aggregates, with logging."""

from __future__ import annotations

import traceback
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from workmill.functions.keys import assign_keys, without_keys
from workmill.functions.moments import month_of, on
from workmill.operators import aggregates, facts, oplog, scd2
from workmill.operators.calendar import dim_time
from workmill.session import broadcastable, cut, discard, release
from workmill.sources.dimension import DimensionTable
from workmill.sources.parts import Parts, bucket_of
from workmill.sources.tables import Versions, balanced, expired, replace_partitions

# The month column of each stored fact, and the order of its rows in a month.
MONTHS = {"fact_tasks": "created_month", "fact_time_logs": "start_month", "fact_task_history": "changed_month"}
SORTED = {"fact_tasks": ("project_key", "assigned_to_key"), "fact_time_logs": ("user_key", "start_timestamp")}
# Of so many loads that rewrite months one gathers all their rows again.
GATHER = 8
# A large load is compared with the stored rows in so many shares of their keys.
SHARES = 4
# Keys of these types are equal exactly if they are the same type and value.
_PLAIN = ("string", "int", "bigint")
BRIDGE, BUCKET = "bridge_task_assignees", "bucket"
DIMENSIONS = {"dim_users": scd2.USERS, "dim_projects": scd2.PROJECTS, "dim_task_status": scd2.TASK_STATUS, "dim_priority": scd2.PRIORITY}


class WorkflowError(RuntimeError):
    pass


@dataclass
class Config:
    """One warehouse: where it lies, where its sources come from, and the run's
    time. `source(name)` returns a source table as a DataFrame."""

    spark: SparkSession
    root: str
    source: Callable[[str], DataFrame]
    as_of: str
    calendar: tuple[str, str] = ("2020-01-01", "2030-12-31")
    completed: Sequence[str] = ("completed",)
    closed: Sequence[str] = ("completed", "cancelled")
    reopen: bool = False
    workload_days: int = 1
    keep_versions: int = 3
    dim_buckets: int = 8
    # Name of the source of task assignments; without one there is no bridge.
    assignments: str | None = None
    bridge_buckets: int = 16
    log: oplog.LoadLog = field(init=False)

    def __post_init__(self):
        self.log = oplog.LoadLog(self.spark, f"{self.root}/log")

    def table(self, name: str) -> Versions | DimensionTable:
        path = f"{self.root}/{name}"
        return DimensionTable(self.spark, path, DIMENSIONS[name], self.dim_buckets) if name in DIMENSIONS else Versions(self.spark, path)

    def fact(self, name: str) -> Parts:
        """A stored fact, by month (the bridge: by key bucket)."""
        return Parts(self.spark, f"{self.root}/{name}", MONTHS.get(name, BUCKET))

    @property
    def statuses(self) -> dict:
        return {"completed": self.completed, "closed": self.closed}


@dataclass(frozen=True)
class Counts:
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0

    @property
    def processed(self) -> int:
        return self.inserted + self.updated + self.unchanged


def _step(cfg: Config, parent: str | None, table: str, operation: str, work: Callable[[str], Counts]) -> Counts:
    """Run one load inside its own batch; a failure is logged and raised."""
    batch = cfg.log.start(f"{table.upper()}_LOAD", parent=parent)
    began = oplog.now()
    try:
        done = work(batch)
        release(cfg.spark)
    except Exception as problem:
        code, text = type(problem).__name__, str(problem)
        cfg.log.error(batch, "ERROR", code, text, table, data={"error_context": f"load of {table}", "trace": traceback.format_exc()})
        cfg.log.audit(batch, table, operation, "FAILED", None, began, oplog.now(), text)
        cfg.log.end(batch, "FAILED", text, processed=0, inserted=0, updated=0, failed=1)
        raise
    try:
        details = {"inserted": done.inserted, "updated": done.updated, "unchanged": done.unchanged}
        cfg.log.audit(batch, table, operation, "COMPLETED", done.inserted + done.updated, began, oplog.now(), details=details)
        cfg.log.end(batch, "COMPLETED", processed=done.processed, inserted=done.inserted, updated=done.updated, failed=0)
    except Exception as problem:
        raise WorkflowError(f"{table}: data written, its log rows not: {problem}") from problem
    return done


def load_time(cfg: Config, parent: str | None = None) -> Counts:
    """Build the date dimension anew (one-time, before the first run)."""

    def work(batch: str) -> Counts:
        days = dim_time(cfg.spark, *cfg.calendar)
        cfg.table("dim_time").write(days.coalesce(1))
        return Counts(inserted=cfg.table("dim_time").read().count())

    return _step(cfg, parent, "dim_time", "LOAD", work)


def load_dimension(cfg: Config, name: str, source: str, spec: scd2.Dimension, parent: str | None = None) -> Counts:
    def work(batch: str) -> Counts:
        table = DimensionTable(cfg.spark, f"{cfg.root}/{name}", spec, cfg.dim_buckets)
        kinds = table.load(cfg.source(source), cfg.as_of, batch, cfg.reopen)
        table.prune(cfg.keep_versions)
        started = kinds["new"] + kinds["changed"] + (kinds["returned"] if cfg.reopen else 0)
        return Counts(started, kinds["changed"] + kinds["deleted"], kinds["unchanged"])

    return _step(cfg, parent, name, "SCD2_LOAD", work)


def _dims(cfg: Config) -> facts.Dims:
    names = ("dim_users", "dim_projects", "dim_task_status", "dim_priority", "dim_time")
    return facts.Dims(*[cfg.table(n).read() for n in names])


def _fact(cfg: Config, name: str) -> DataFrame:
    return cfg.fact(name).read()


def _incremental(
    cfg: Config,
    name: str,
    incoming: DataFrame,
    ids: DataFrame,
    key: str,
    surrogate: str,
    tracked: Sequence[str],
    ts: str,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    shares: int = 1,
    rests: Sequence[DataFrame] = (),
) -> Counts:
    """Bring a fact stored by month up to date with resolved source rows.

    One write: months with a changed row are written anew, new rows of other
    months are added to them, and all become visible together. The highest
    surrogate lies beside the manifest, so numbering needs no scan. `finish`
    adds the columns that follow from others, after the rows have shuffled.

    Changed and new rows are gathered by month. Rows that stay are in files of
    their month already and are not, except in every `GATHER`th such load,
    which keeps files few.

    What a phase shuffled and wrote for itself goes when the next has its rows,
    so the disk holds one at a time. `shares` says in how many the rows are
    compared; `incoming` is computed anew for each. `rests` are tables written
    for `incoming` alone, which go too.
    """
    table, month = cfg.fact(name), MONTHS[name]
    incoming = incoming.withColumn(month, month_of(F.col(ts)))

    def gathered(rows: DataFrame) -> DataFrame:
        done = finish(balanced(rows, [month]))
        return done.select(surrogate, *[c for c in done.columns if c not in (surrogate, month)], month)

    def layout(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(month, *SORTED[name])

    if not table.exists():
        first = assign_keys(incoming, surrogate)
        release(cfg.spark)
        n = first.count()
        table.commit(gathered(first), layout=layout, note={"top": n})
        discard(first)
        return Counts(inserted=n)
    fact, note = table.read(), table.note()
    load, kinds, delta = _compared(cfg, fact, incoming, key, surrogate, tracked, ids, month, shares)
    discard(*rests)
    if kinds["new"] + kinds["changed"]:
        changed, of_month = load.of("changed"), lambda rows: rows.drop("stored_part")
        fresh = assign_keys(of_month(load.of("new")).drop(surrogate), surrogate, start=note["top"] + 1)
        if _alone(fact, changed, key, surrogate, note["top"]):
            months = [r[0] for r in changed.select("stored_part").distinct().collect()]  # at most the months
            stays = without_keys(table.read(only=months), surrogate, changed, note["top"])
        else:
            months = facts.rewritten_partitions(load, month)
            stays = table.read(only=months).join(changed.select(key), key, "left_anti")
        loads = note.get("loads", 0) + 1
        stays = balanced(stays, [month]) if loads % GATHER == 0 else stays
        rows = stays.unionByName(gathered(of_month(changed).unionByName(fresh)).select(*fact.columns))
        table.commit(rows, replaced=months, layout=layout, note={"top": note["top"] + kinds["new"], "loads": loads})
        discard(fresh)
        table.compact()
        # What the history has not been taken from yet is kept.
        table.prune(cfg.keep_versions, cfg.fact("fact_task_history").note().get("seen") if name == "fact_tasks" else None)
    discard(*delta)
    return Counts(kinds["new"], kinds["changed"], kinds["unchanged"])


def _compared(
    cfg: Config, fact: DataFrame, incoming: DataFrame, key: str, surrogate: str, tracked: Sequence[str], ids: DataFrame, part: str, shares: int
) -> tuple[facts.FactLoad, dict[str, int], list[DataFrame]]:
    """The new and changed rows, written; how many rows there are of each kind;
    and the tables written.

    Equal keys are in the same share, and the shuffles of a share go before the
    next one's come.
    """
    if incoming.schema[key].dataType != fact.schema[key].dataType or fact.schema[key].dataType.simpleString() not in _PLAIN:
        shares = 1
    delta, kinds = [], {}
    for share in range(shares):
        own = F.pmod(F.xxhash64(key), F.lit(shares)) == share if shares > 1 else F.lit(True)
        load, found = facts.classify(fact.filter(own), incoming.filter(own), key, surrogate, tracked, ids, part).settled()
        release(cfg.spark)
        delta.append(load.classified)
        kinds = {kind: kinds.get(kind, 0) + n for kind, n in found.items()}
    return facts.FactLoad(fact, reduce(DataFrame.unionByName, delta), key, surrogate), kinds, delta


def _alone(fact: DataFrame, changed: DataFrame, key: str, surrogate: str, top: int) -> bool:
    """Whether the stored rows with the key of a changed one are those whose
    numbers the changed rows bear. Hashes of keys only: equal ones of different
    keys say no, which costs time alone."""
    others = without_keys(fact.filter(F.col(key).isNotNull()).select(surrogate, key), surrogate, changed, top)
    hashed = [rows.select(F.xxhash64(key).alias("__hash")) for rows in (others, changed)]
    return hashed[0].join(hashed[1], "__hash", "left_semi").count() == 0


def drop_expired(cfg: Config, name: str, days: int) -> list[str]:
    """Take months out of a stored fact that ended before the last `days` days;
    no row is read or written."""
    return cfg.fact(name).drop(expired(MONTHS[name], days, cfg.as_of))


def load_tasks(cfg: Config, parent: str | None = None) -> Counts:
    """Incremental task fact, stored by creation month."""

    def work(batch: str) -> Counts:
        tasks = cfg.source("tasks")
        rows = facts.resolve_tasks(tasks, _dims(cfg), cfg.as_of, batch, **cfg.statuses)
        ids = tasks.select("task_id")
        return _incremental(cfg, "fact_tasks", rows, ids, "task_id", "task_key", facts.TRACKED, "created_timestamp")

    return _step(cfg, parent, "fact_tasks", "INCREMENTAL_LOAD", work)


def load_time_logs(cfg: Config, parent: str | None = None) -> Counts:
    """Incremental time-log fact, stored by start month.

    Logs too many to broadcast are written with their task keys, so that what
    the source and the match with tasks shuffled can go, and then compared in
    shares, if they are many as written too.
    """

    def work(batch: str) -> Counts:
        dims, logs, written = _dims(cfg), cfg.source("time_logs"), []
        ids = logs.select("log_id")
        many = cfg.fact("fact_time_logs").exists() and not broadcastable(ids)

        def settle(rows: DataFrame) -> DataFrame:
            written.append(cut(rows))
            release(cfg.spark)
            return written[0]

        rows = facts.keyed_time_logs(logs, _fact(cfg, "fact_tasks"), dims.users, *([settle] if many else []))
        return _incremental(
            cfg,
            "fact_time_logs",
            rows,
            ids,
            "time_log_id",
            "time_log_key",
            facts.LOG_TRACKED,
            "start_timestamp",
            lambda found: facts.with_log_measures(found, dims.time, batch, cfg.as_of, ["time_log_key", MONTHS["fact_time_logs"]]),
            SHARES if written and not broadcastable(written[0]) else 1,
            written,
        )

    return _step(cfg, parent, "fact_time_logs", "INCREMENTAL_LOAD", work)


def load_history(cfg: Config, parent: str | None = None) -> Counts:
    """Append the changes of the task fact since the history was last loaded.

    Only partitions whose files changed are compared. What was seen is kept
    beside the rows it led to, so a run that died is made up for by the next.
    """

    def work(batch: str) -> Counts:
        fact, table, month = cfg.fact("fact_tasks"), cfg.fact("fact_task_history"), MONTHS["fact_task_history"]
        note, number = table.note() or {"seen": 0, "top": 0}, fact.number()
        if note["seen"] == number:
            return Counts()
        old, new = fact.changes(note["seen"])
        changes = facts.fact_history(new.limit(0) if old is None else old, new, _dims(cfg).time, cfg.as_of, batch)
        rows = assign_keys(changes.withColumn(month, month_of(F.col("changed_timestamp"))), "history_key", start=note["top"] + 1)
        n = rows.count()
        # All of one month, that of the load, so there is nothing to gather.
        release(cfg.spark)
        table.commit(rows, layout=lambda df: df, note={"seen": number, "top": note["top"] + n})
        discard(rows)
        table.compact()
        table.prune(cfg.keep_versions)
        return Counts(inserted=n)

    return _step(cfg, parent, "fact_task_history", "INCREMENTAL_LOAD", work)


def load_assignments(cfg: Config, parent: str | None = None) -> Counts:
    """The task/user bridge; only buckets in which a pair came, went or changed
    are written anew."""

    def work(batch: str) -> Counts:
        table, key = cfg.fact(BRIDGE), ["task_key", "user_key"]
        rows = facts.load_bridge(cfg.source(cfg.assignments), cfg.source("tasks"), _fact(cfg, "fact_tasks"), cfg.table("dim_users").current(), _dims(cfg).time, batch, cfg.as_of)
        buckets = table.note().get("buckets", cfg.bridge_buckets)
        rows = cut(rows.withColumn(BUCKET, bucket_of(key, buckets)))
        if not table.exists():
            table.commit(rows, note={"buckets": buckets})
            n = rows.count()
            discard(rows)
            return Counts(inserted=n)
        stored = table.read()
        told = [c for c in rows.columns if not c.startswith("etl_") and c not in (*key, BUCKET)]
        a = stored.select(BUCKET, *key, F.struct(*told).alias("was"))
        b = rows.select(BUCKET, *key, F.struct(*told).alias("is"))
        pairs = a.join(b, [BUCKET, *key], "full").withColumn(
            "kind",
            F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "changed").otherwise("same"),
        )
        kinds = cut(pairs.groupBy(BUCKET, "kind").agg(F.count(F.lit(1)).alias("n")))
        touched = [r[0] for r in kinds.filter("kind <> 'same'").select(BUCKET).distinct().collect()]  # at most the buckets
        if touched:
            # Pairs that stay as they are keep the batch that brought them.
            same = pairs.filter("kind = 'same'").select(BUCKET, *key)
            stays = stored.filter(F.col(BUCKET).isin(touched)).join(same, [BUCKET, *key], "left_semi")
            fresh = rows.filter(F.col(BUCKET).isin(touched)).join(same, [BUCKET, *key], "left_anti")
            table.commit(stays.select(*rows.columns).unionByName(fresh), replaced=touched, note={"buckets": buckets})
            table.prune(cfg.keep_versions)
        n = {r[0]: r[1] for r in kinds.groupBy("kind").agg(F.sum("n")).collect()}
        discard(rows, kinds)
        return Counts(n.get("new", 0), n.get("changed", 0) + n.get("gone", 0), n.get("same", 0))

    return _step(cfg, parent, BRIDGE, "INCREMENTAL_LOAD", work)


def _tenant(rows: DataFrame) -> list[str]:
    return [c for c in ("organization_id",) if c in rows.columns]


def _load_snapshot(cfg: Config, name: str, rows: DataFrame) -> Counts:
    """Aggregates are stored by snapshot day; a rerun replaces that day."""
    rows = cut(rows.withColumn("snapshot_date", on(cfg.as_of)))
    replace_partitions(rows, f"{cfg.root}/{name}", ["snapshot_date"])
    n = rows.count()
    discard(rows)
    return Counts(inserted=n)


def load_daily_metrics(cfg: Config, parent: str | None = None) -> Counts:
    def work(batch: str) -> Counts:
        dims = _dims(cfg)
        fact = _fact(cfg, "fact_tasks")
        rows = aggregates.daily_task_metrics(fact, dims.status, dims.time, cfg.as_of, batch_id=batch, tenant=_tenant(fact), **cfg.statuses)
        return _load_snapshot(cfg, "agg_daily_task_metrics", rows)

    return _step(cfg, parent, "agg_daily_task_metrics", "LOAD", work)


def load_workload(cfg: Config, parent: str | None = None) -> Counts:
    def work(batch: str) -> Counts:
        dims = _dims(cfg)
        fact, logs = _fact(cfg, "fact_tasks"), _fact(cfg, "fact_time_logs")
        rows = aggregates.user_workload_agg(
            fact,
            logs,
            dims.status,
            dims.time,
            cfg.as_of,
            cfg.workload_days,
            batch_id=batch,
            tenant=_tenant(fact) if _tenant(fact) == _tenant(logs) else [],
            **cfg.statuses,
        )
        return _load_snapshot(cfg, "agg_user_workload", rows)

    return _step(cfg, parent, "agg_user_workload", "LOAD", work)


def _standard(cfg: Config, parent: str) -> list[Callable[[], Counts]]:
    return [
        lambda: load_dimension(cfg, "dim_users", "users", scd2.USERS, parent),
        lambda: load_dimension(cfg, "dim_projects", "projects", scd2.PROJECTS, parent),
        lambda: load_dimension(cfg, "dim_task_status", "task_status", scd2.TASK_STATUS, parent),
        lambda: load_dimension(cfg, "dim_priority", "priority", scd2.PRIORITY, parent),
        lambda: load_tasks(cfg, parent),
        lambda: load_time_logs(cfg, parent),
        lambda: load_history(cfg, parent),
        *([lambda: load_assignments(cfg, parent)] if cfg.assignments else []),
        lambda: load_daily_metrics(cfg, parent),
        lambda: load_workload(cfg, parent),
    ]


def run_workflow(cfg: Config, raise_on_error: bool = True) -> str:
    """One full run; returns the master batch id.

    Steps run in order and the first failure stops the run. It is logged as
    CRITICAL and raised, or only warned about with `raise_on_error=False` (what
    a scheduled call wants). The master batch carries the sums of its steps.
    """
    batch = cfg.log.start("FULL_ETL_WORKFLOW", "ETL_MASTER")
    try:
        if not cfg.table("dim_time").exists():
            load_time(cfg, batch)
        results = [step() for step in _standard(cfg, batch)]
    except Exception as problem:
        text = str(problem)
        cfg.log.error(batch, "CRITICAL", type(problem).__name__, text, "ETL_WORKFLOW", data={"error_context": "full run"})
        cfg.log.end(batch, "FAILED", text, failed=1)
        if raise_on_error:
            raise WorkflowError(f"workflow failed: {text}") from problem
        warnings.warn(f"workflow failed: {text}", stacklevel=2)
        return batch
    cfg.log.end(
        batch,
        "COMPLETED",
        details={"message": "workflow completed"},
        processed=sum(r.processed for r in results),
        inserted=sum(r.inserted for r in results),
        updated=sum(r.updated for r in results),
        failed=0,
    )
    return batch


__all__ = ["Config", "Counts", "WorkflowError", "drop_expired", "load_dimension", "load_tasks", "load_time", "load_time_logs", "run_workflow"]
