"""A partitioned table whose contents a manifest names, swapped by one rename.

    <path>/data/load=<id>/<part>=<value>/part-*.parquet
    <path>/manifest/<number>.json

A write adds one load directory, once, with the rows of the partitions it
touches; the next manifest then says of every partition which loads it is made
of. Readers go through the newest manifest, so they see all of a write or none
of it, a load may read the partitions it replaces while it writes, and what no
partition names any more stays until it is pruned. Replacing, appending and
dropping partitions are all a new list of loads.

The manifest has an entry a partition and load; keep partitions coarse (months,
key buckets) and compact those that were appended to often. Two writers cannot
both commit the same number: the second rename fails, its rows stay unseen and
the caller runs again. That needs a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from workmill.sources.tables import balanced


class Conflict(RuntimeError):
    """Another writer committed first."""


class Parts:
    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part = spark, path, part
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # -- files ------------------------------------------------------------------

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def _manifest(self, number: int | None = None) -> dict:
        """A manifest (the newest by default); of an unwritten table an empty one."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return {"number": 0, "schema": None, "parts": {}, "note": {}}
            number = numbers[-1]
        path, fs = self._at(f"manifest/{number:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Make a manifest the newest one: the only step readers can notice."""
        draft, fs = self._at(f"manifest/.{uuid.uuid4()}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final, _ = self._at(f"manifest/{manifest['number']:010d}.json")
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        files = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, none)
        except Exception as problem:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"{self.path}: version {manifest['number']} is taken") from problem
            raise

    def directory(self, value) -> str:
        """The directory name of a partition value, as Spark writes it."""
        text = None if value is None else str(value)
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(self.part, text)

    # -- reading ----------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._numbers())

    def note(self) -> dict:
        """What the last commit left beside the data."""
        return self._manifest()["note"]

    def parts(self) -> dict[str, list[str]]:
        """Directory name of each partition and the loads it is made of."""
        return self._manifest()["parts"]

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._manifest()["schema"]))

    def load(self, load: str) -> DataFrame:
        """What the table still has of one load."""
        manifest = self._manifest()
        own = {name: [load] for name, loads in manifest["parts"].items() if load in loads}
        return self._rows(own, None, manifest["schema"])

    def number(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        return self._manifest()["number"]

    def changes(self, since: int) -> tuple[DataFrame | None, DataFrame]:
        """The partitions whose loads differ from manifest `since`: as they were
        (None for 0) and as they are. Partitions that did not change are not read."""
        now = self._manifest()
        then = self._manifest(since)["parts"] if since else {}
        names = {n for n in {*then, *now["parts"]} if then.get(n) != now["parts"].get(n)}
        return (self._rows(then, names, now["schema"]) if since else None), self._rows(now["parts"], names, now["schema"])

    def read(self, only: Iterable | None = None, number: int | None = None) -> DataFrame:
        """The table, or the partitions of the given values, as of a manifest.

        The partition column is known from the directories, so a predicate on
        it drops them before any file is opened.
        """
        manifest = self._manifest(number)
        if manifest["schema"] is None:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        wanted = None if only is None else {self.directory(v) for v in only}
        return self._rows(manifest["parts"], wanted, manifest["schema"])

    def _rows(self, parts: dict[str, list[str]], wanted: set[str] | None, schema: str) -> DataFrame:
        paths = [f"{self.path}/data/load={load}/{name}" for name, loads in parts.items() if wanted is None or name in wanted for load in loads]
        kind = StructType.fromJson(json.loads(schema))
        if not paths:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*kind.names)

    # -- writing ----------------------------------------------------------------

    def commit(
        self,
        rows: DataFrame,
        replaced: Iterable | Callable[[str], bool] = (),
        layout: Callable[[DataFrame], DataFrame] | None = None,
        note: dict | None = None,
    ) -> dict[str, list[str]]:
        """Write `rows` once and publish them.

        Partitions named in `replaced` (values, or a test of their directory
        names) hold nothing but their rows of this write afterwards, and go if
        there are none; any other partition keeps its loads and gets its rows
        added. `layout` orders the rows before they are written, instead of
        gathering each partition. Returns the partitions written.
        """
        base = self._manifest()
        load = f"{base['number'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        schema = StructType.fromJson(json.loads(base["schema"])) if base["schema"] else rows.schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        arranged = layout(rows) if layout else balanced(rows, [self.part])
        arranged.write.partitionBy(self.part).parquet(f"{self.path}/data/load={load}")
        new = {n for n in self._names(f"data/load={load}") if n.startswith(f"{self.part}=")}
        gone = replaced if callable(replaced) else {self.directory(v) for v in replaced}.__contains__
        parts = {name: loads for name, loads in base["parts"].items() if not gone(name)}
        for name in sorted(new):
            parts[name] = [*parts.get(name, []), load]
        self._publish({"number": base["number"] + 1, "schema": schema.json(), "parts": parts, "note": note or base["note"]})
        return {name: parts[name] for name in new}

    def compact(self, most: int = 8) -> list[str]:
        """Write partitions made of more than `most` loads anew, as one load each."""
        manifest = self._manifest()
        many = sorted(name for name, loads in manifest["parts"].items() if len(loads) > most)
        if many:
            self.commit(self._rows(manifest["parts"], set(many), manifest["schema"]), replaced=set(many).__contains__)
        return many

    def drop(self, gone: Callable[[str], bool]) -> list[str]:
        """Take partitions out by directory name, without reading a row."""
        base = self._manifest()
        names = sorted(name for name in base["parts"] if gone(name))
        if names:
            parts = {name: loads for name, loads in base["parts"].items() if name not in set(names)}
            self._publish({**base, "number": base["number"] + 1, "parts": parts})
        return names

    def prune(self, keep: int = 2, since: int | None = None) -> int:
        """Delete what only manifests before the newest `keep` (and before `since`)
        name; returns the directories deleted. A write that is not published
        yet is not touched."""
        numbers = self._numbers()
        old = [n for n in numbers[:-keep] if since is None or n < since]
        kept = [n for n in numbers if n not in set(old)]
        used = {(load, name) for n in kept for name, loads in self._manifest(n)["parts"].items() for load in loads}
        dead = {(load, name) for n in old for name, loads in self._manifest(n)["parts"].items() for load in loads} - used
        for load, name in sorted(dead):
            path, fs = self._at(f"data/load={load}/{name}")
            fs.delete(path, True)
            if not any(n.startswith(f"{self.part}=") for n in self._names(f"data/load={load}")):
                path, fs = self._at(f"data/load={load}")
                fs.delete(path, True)
        for n in old:
            path, fs = self._at(f"manifest/{n:010d}.json")
            fs.delete(path, False)
        return len(dead)


def bucket_of(key: str | list[str], count: int) -> Column:
    """The bucket of a key, for tables whose partitions are key buckets."""
    keys = [key] if isinstance(key, str) else key
    return F.pmod(F.hash(*keys), F.lit(count))
