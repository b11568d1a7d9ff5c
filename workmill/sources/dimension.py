"""A version-keeping dimension on disk: current versions by key bucket, closed ones appended.

A load writes the versions it ends, the ones it starts, and the current rows of
those buckets in which one ended. Closed versions are never written again
(except by compaction), and a bucket that only gains keys is appended to. All of
it becomes visible at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from workmill.functions.keys import assign_keys
from workmill.operators import scd2
from workmill.session import cut, discard
from workmill.sources.parts import Parts, bucket_of

_PART = "part"
_CLOSED = -1  # the partition of closed versions; the others are buckets of current ones


class DimensionTable:
    def __init__(self, spark: SparkSession, path: str, spec: scd2.Dimension, buckets: int = 8):
        self.spec, self.buckets = spec, buckets
        self.parts = Parts(spark, path, _PART)

    def exists(self) -> bool:
        return self.parts.exists()

    def read(self) -> DataFrame:
        """All versions; `is_current` tells them apart, and opens only those files."""
        return self.parts.read().drop(_PART)

    def current(self) -> DataFrame:
        return self.parts.read().filter(F.col(_PART) >= 0).drop(_PART)

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = bucket_of(self.spec.key, self.parts.note()["buckets"] if self.exists() else self.buckets)
        return rows.withColumn(_PART, F.when(F.col("is_current"), bucket).otherwise(_CLOSED).cast("int"))

    def _numbered(self, rows: DataFrame, start: int) -> DataFrame:
        keyed = assign_keys(rows.drop(self.spec.surrogate), self.spec.surrogate, start=start)
        return keyed.withColumn(self.spec.surrogate, F.col(self.spec.surrogate).cast("int")).select(*rows.columns)

    def load(self, src: DataFrame, as_of, batch_id: str | None = None, reopen: bool = False, most: int = 8) -> dict[str, int]:
        """Bring the dimension up to date with `src`; returns keys per kind.

        The highest surrogate and the number of buckets are kept beside the
        manifest, so neither needs a scan.
        """
        if not self.exists():
            first = self._numbered(scd2.first_version(src, None, self.spec, as_of, batch_id), 1)
            n = first.count()
            self.parts.commit(self._placed(first), note={"top": n, "buckets": self.buckets})
            discard(first)
            return dict.fromkeys(scd2.KINDS, 0) | {"new": n}
        note, stored = self.parts.note(), self.parts.read()
        seen = Observation()
        changes = cut(scd2.scd2_changes(stored.drop(_PART), src, self.spec, as_of, batch_id, reopen, observe=seen))
        kinds = seen.get
        started = kinds["new"] + kinds["changed"] + (kinds["returned"] if reopen else 0)
        ended = kinds["changed"] + kinds["deleted"]
        if started + ended:
            closed = changes.filter(~F.col("is_current"))
            fresh = self._numbered(changes.filter("is_current"), note["top"] + 1)
            bucket = bucket_of(self.spec.key, note["buckets"])
            touched = [r[0] for r in closed.select(bucket).distinct().collect()]  # at most the buckets
            stays = stored.filter(F.col(_PART).isin(touched)).join(closed.select(self.spec.key), self.spec.key, "left_anti")
            rows = stays.drop(_PART).select(*changes.columns).unionByName(closed).unionByName(fresh)
            self.parts.commit(self._placed(rows), replaced=touched, note={**note, "top": note["top"] + started})
            discard(fresh)
            self.parts.compact(most)
        discard(changes)
        return kinds

    def prune(self, keep: int = 2) -> None:
        self.parts.prune(keep)
