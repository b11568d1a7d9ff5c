"""Scheduled incremental runs over newly landed files."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.plans.workflow import Config, run_workflow
from workmill.session import cut
from workmill.sources.parts import Parts, bucket_of


def newest_per_key(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest `order` values of each key.

    An aggregate rather than a window: combined before the shuffle, so a key
    with very many rows sends one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return rows.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*rows.columns)


def merge_newest(stored: DataFrame | None, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Stored rows and a batch, newest row per key.

    Keyed and idempotent: a replayed batch or a late older row changes nothing,
    so no watermark is needed. The batch is reduced and written out first, so
    its size is known: a small one is broadcast and the stored rows, which only
    meet it in a semi and an anti join, are not shuffled.
    """
    fresh = cut(newest_per_key(batch, key, order))
    if stored is None:
        return fresh
    keys = fresh.select(key)
    rivals = stored.join(keys, key, "left_semi").unionByName(fresh)
    return stored.join(keys, key, "left_anti").unionByName(newest_per_key(rivals, key, order))


def run_available(
    spark: SparkSession,
    folder: str,
    schema,
    state: str,
    handle: Callable[[DataFrame, int], None],
    pattern: str = "*.parquet",
) -> None:
    """Process every file that landed since the last run, then stop.

    `state` holds the source position; a run that died resumes from it and the
    interrupted micro-batch is handed over again with the same id.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(handle).start()
    )
    query.awaitTermination()


class NewestTable:
    """The newest row per key, stored by key bucket.

    An upsert keeps of a batch only rows newer than the stored ones and rewrites
    only buckets in which a stored row is replaced; buckets that only gain keys
    are appended to. A batch seen before, late or replayed, writes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], order: Sequence[str], buckets: int = 32):
        self.keys, self.order, self.buckets = [key] if isinstance(key, str) else list(key), list(order), buckets
        self.parts = Parts(spark, path, "bucket")

    def exists(self) -> bool:
        return self.parts.exists()

    def read(self) -> DataFrame:
        return self.parts.read().drop("bucket")

    def upsert(self, batch: DataFrame, keep: int = 3, most: int = 8) -> int:
        """Take a batch in; returns the rows that were new or newer."""
        fresh = newest_per_key(batch, self.keys, self.order)
        note = self.parts.note() or {"buckets": self.buckets}
        fresh = cut(fresh.withColumn("bucket", bucket_of(self.keys, note["buckets"])))
        if not self.exists():
            self.parts.commit(fresh, note=note)
            return fresh.count()
        known = self.parts.read().select("bucket", *self.keys, F.struct(*self.order).alias("__old"))
        # The bucket is part of the join: stored partitions without a fresh row are not read.
        same = [fresh["bucket"] == known["bucket"], *[fresh[k].eqNullSafe(known[k]) for k in self.keys]]
        wins = fresh.join(known, same, "left").filter(F.col("__old").isNull() | (F.struct(*[fresh[c] for c in self.order]) > F.col("__old")))
        wins = cut(wins.select(*[fresh[c] for c in fresh.columns], F.col("__old").isNotNull().alias("__replaces")))
        number = wins.count()
        if number:
            touched = [r[0] for r in wins.filter("__replaces").select("bucket").distinct().collect()]  # at most the buckets
            stored, gone = self.parts.read(only=touched), wins.filter("__replaces")
            stays = stored.join(gone, [stored[k].eqNullSafe(gone[k]) for k in self.keys], "left_anti")
            self.parts.commit(stays.unionByName(wins.drop("__replaces")), replaced=touched, note=note)
            self.parts.compact(most)
            self.parts.prune(keep)
        return number


def upsert_into(table: NewestTable, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A batch handler that keeps the newest row per key in `table`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.upsert(prepare(batch) if prepare else batch)

    return handle


@dataclass(frozen=True)
class Landing:
    """A folder where changed rows of one source table arrive as files."""

    name: str
    folder: str
    schema: str
    key: str
    order: tuple[str, ...]


def scheduled_run(cfg: Config, landings: Sequence[Landing]) -> str:
    """What a scheduler calls: take in what has landed, then run the full load.

    Each landing is brought to its newest row per key under `<root>/source`;
    the load then reads those tables, and any other from `cfg.source`. The load
    compares by key, so running again without new files changes nothing. A
    failure is logged and warned about, not raised.
    """
    given = cfg.source
    tables = {land.name: NewestTable(cfg.spark, f"{cfg.root}/source/{land.name}", land.key, land.order) for land in landings}
    for land in landings:
        try:
            state = f"{cfg.root}/source/_state/{land.name}"
            run_available(cfg.spark, land.folder, land.schema, state, upsert_into(tables[land.name]))
        except Exception as problem:
            batch, text = cfg.log.start(f"{land.name.upper()}_LANDING"), str(problem)
            cfg.log.error(batch, "CRITICAL", type(problem).__name__, text, land.name, data={"error_context": f"landing of {land.name}"})
            cfg.log.end(batch, "FAILED", text, failed=1)
            warnings.warn(f"landing of {land.name} failed: {text}", stacklevel=2)
            return batch

    def source(name: str) -> DataFrame:
        return tables[name].read() if name in tables and tables[name].exists() else given(name)

    cfg.source = source
    try:
        return run_workflow(cfg, raise_on_error=False)
    finally:
        cfg.source = given
