"""A profile of a growing table that reads each load once.

For every load of a `Parts` table and every column it keeps what can be merged:
numbers of rows and of missing values, least and largest value, a sketch of the
distinct values (HyperLogLog) and, for numbers and times, one of the quantiles
(KLL). A refresh reads loads it has not seen, forgets those that are gone, and
the profile of the table is the merge of what is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from workmill.sources.parts import Parts

_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
_TIMES = ("date", "timestamp", "timestamp_ntz")
QUANTILES = (0.25, 0.5, 0.75)


def _number(name: str, kind: str) -> Column:
    """The value as a number: times as microseconds."""
    return (F.unix_micros(F.col(name).cast("timestamp")) if kind in _TIMES else F.col(name)).cast("double")


def _kinds(schema: StructType) -> dict[str, str]:
    """The columns a profile has, with their types; nested ones have none."""
    return {f.name: f.dataType.typeName() for f in schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")}


class Profile:
    def __init__(self, spark: SparkSession, path: str, table: Parts):
        self.table, self.kept = table, Parts(spark, path, "of")

    def _columns(self, schema: StructType) -> list[Column]:
        out = [F.count(F.lit(1)).alias("rows")]
        for i, (c, kind) in enumerate(_kinds(schema).items()):
            out += [
                F.count_if(F.col(c).isNull()).alias(f"null{i}"),
                F.min(c).alias(f"min{i}"),
                F.max(c).alias(f"max{i}"),
                F.hll_sketch_agg(F.col(c).cast("string")).alias(f"hll{i}"),
            ]
            if kind in _NUMBERS:
                out.append(F.kll_sketch_agg_double(_number(c, kind)).alias(f"kll{i}"))
        return out

    def refresh(self) -> list[str]:
        """Bring the profile up to date; returns the loads that were read."""
        parts = self.table.parts()
        have = self.kept.parts()
        wanted = {(load, name) for name, loads in parts.items() for load in loads}
        known = {tuple(x) for x in self.kept.note().get("loads", [])}
        # A load of which some partitions are gone is read again as it is now.
        whole = {load for load, _ in wanted}
        stale = {load for load, _ in known ^ wanted}
        fresh = sorted(whole & stale)
        gone = {self.kept.directory(load) for load in {load for load, _ in known} & stale}
        note = {"loads": sorted(map(list, wanted))}
        if fresh:
            rows = reduce(DataFrame.unionByName, [self.table.load(load).withColumn("of", F.lit(load)) for load in fresh])
            stats = rows.groupBy("of").agg(*self._columns(self.table.schema()))
            self.kept.commit(stats, replaced=lambda name: name in gone, note=note)
        elif gone & set(have):
            self.kept.drop(lambda name: name in gone)
        self.kept.prune(1)
        return fresh

    def read(self) -> DataFrame:
        """(column_name, row_count, null_count, distinct_estimate, min_value,
        max_value, quantiles): the merge of all loads."""
        kinds = _kinds(self.table.schema())
        aggs = [F.sum("rows").alias("rows")]
        for i, kind in enumerate(kinds.values()):
            aggs += [F.sum(f"null{i}").alias(f"null{i}"), F.min(f"min{i}").alias(f"min{i}"), F.max(f"max{i}").alias(f"max{i}"), F.hll_union_agg(f"hll{i}").alias(f"hll{i}")]
            if kind in _NUMBERS:
                aggs.append(F.kll_merge_agg_double(f"kll{i}").alias(f"kll{i}"))
        one = self.kept.read().agg(*aggs)
        cells = []
        for i, (c, kind) in enumerate(kinds.items()):
            places = F.array(*[F.lit(q) for q in QUANTILES])
            quantiles = F.when(F.col("rows") > F.col(f"null{i}"), F.kll_sketch_get_quantile_double(f"kll{i}", places)) if kind in _NUMBERS else F.lit(None)
            cells.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col("rows").alias("row_count"),
                    F.col(f"null{i}").alias("null_count"),
                    F.hll_sketch_estimate(f"hll{i}").alias("distinct_estimate"),
                    F.col(f"min{i}").cast("string").alias("min_value"),
                    F.col(f"max{i}").cast("string").alias("max_value"),
                    quantiles.cast("array<double>").alias("quantiles"),
                )
            )
        return one.select(F.inline(F.array(*cells)))
