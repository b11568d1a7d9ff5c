"""Dimension lookups: current version, valid at a time, date keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmill.session import cut

UNKNOWN = -1
_NULL_SPREAD = 64


def current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("is_current"))


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    key: str,
    take: Mapping[str, str],
    spread: int = 1,
    by: str | None = None,
    nullable: bool = True,
) -> DataFrame:
    """Left join that adds dimension columns under new names.

    `take` maps output name -> dimension column. The dimension is broadcast
    only when Catalyst's size estimate is under the broadcast threshold;
    otherwise both sides shuffle on the key. Rows without a key (unassigned
    tasks) match nothing, so they are spread over many tasks instead of
    meeting in one. `spread` > 1 also spreads every present key that many ways
    (the dimension is repeated as often) for a key AQE cannot split. Rows are
    spread by a hash of `by`, by default the first column, which should be the
    row's own id.

    `nullable=False` says the key is always there: the join is then on the key
    alone and can use tables already partitioned or bucketed on it.
    """
    if spread == 1 and not nullable:
        right = dim.selectExpr(f"`{key}` AS __dim_key", *[f"`{c}` AS `{name}`" for name, c in take.items()])
        return df.join(right, F.expr(f"`{on}` = __dim_key"), "left").drop("__dim_key")
    noise = f"xxhash64(`{by or df.columns[0]}`)"
    present = "0" if spread == 1 else f"CAST(pmod({noise}, {spread}) AS INT)"
    salt = f"CASE WHEN `{on}` IS NULL THEN CAST(pmod({noise}, {_NULL_SPREAD}) AS INT) ELSE {present} END"
    # pmod(hash, 1) is always 0 but stays an expression of the row, so the
    # salt remains part of the join key instead of folding into a filter.
    zero = f"CAST(pmod(xxhash64(`{key}`), 1) AS INT)"
    dim_salt = zero if spread == 1 else f"explode(sequence({zero}, {zero} + {spread - 1}))"
    right = dim.selectExpr(
        f"`{key}` AS __dim_key", f"{dim_salt} AS __dim_salt", *[f"`{c}` AS `{name}`" for name, c in take.items()]
    )
    left = df.withColumn("__salt", F.expr(salt))
    matched = F.expr(f"`{on}` = __dim_key AND __salt = __dim_salt")
    return left.join(right, matched, "left").drop("__salt", "__dim_key", "__dim_salt")


def date_lookup(df: DataFrame, dim_time: DataFrame, ts: str, out: str, unknown: bool = False) -> DataFrame:
    """Key of the calendar day of `ts`.

    The date dimension has one row per day, so its size is bounded by its date
    range and it is broadcast. `unknown=True` gives -1 instead of NULL.
    """
    days = dim_time.filter(f"time_key <> {UNKNOWN}").selectExpr("full_date AS __day", f"time_key AS `{out}`")
    found = df.join(F.broadcast(days), F.expr(f"to_date(`{ts}`) = __day"), "left").drop("__day")
    return found.withColumn(out, F.expr(f"coalesce(`{out}`, {UNKNOWN})")) if unknown else found


def gap_free(dim: DataFrame, key: str) -> DataFrame:
    """Add `valid_to`: when the next version starts (NULL for the last one).

    An expired version ends one second before the next begins; a time inside
    that second belongs to no version by `expiry_date` alone. Versions are
    numbered without gaps, so the next one is found by an equi join on
    (key, version_number + 1) rather than a window over each key.
    """
    following = dim.select(
        F.col(key).alias("__next_key"),
        (F.col("version_number") - 1).alias("__before"),
        F.col("effective_date").alias("valid_to"),
    )
    same = (F.col(key) == F.col("__next_key")) & (F.col("version_number") == F.col("__before"))
    return dim.join(following, same, "left").drop("__next_key", "__before")


def lookup_as_of(df: DataFrame, dim: DataFrame, on: str, ts: str, key: str, take: Mapping[str, str]) -> DataFrame:
    """Left join to the dimension version valid at `ts`.

    The equi key keeps this a hash or merge join; the validity range is a
    residual condition. A version that ended without a successor (deleted
    entity) is valid up to its expiry date. Rows without a key are spread as in
    `lookup`.
    """
    # All columns, since one alone may hold the same value in every row.
    noise = F.pmod(F.xxhash64(*df.columns), F.lit(_NULL_SPREAD)).cast("int")
    salted = df.withColumn("__salt", F.when(F.col(on).isNull(), noise).otherwise(0))
    spans = gap_free(dim, key).select(
        F.col(key).alias("__dim_key"),
        F.expr(f"CAST(pmod(xxhash64(`{key}`), 1) AS INT)").alias("__dim_salt"),
        F.col("effective_date").alias("__from"),
        F.col("valid_to").alias("__to"),
        F.col("expiry_date").alias("__expiry"),
        *[F.col(c).alias(f"__take{i}") for i, c in enumerate(take.values())],
    )
    when = F.col(ts)
    before_end = F.when(F.col("__to").isNotNull(), when < F.col("__to")).otherwise(
        F.col("__expiry").isNull() | (when <= F.col("__expiry"))
    )
    same = (F.col(on) == F.col("__dim_key")) & (F.col("__salt") == F.col("__dim_salt"))
    valid = same & (F.col("__from") <= when) & before_end
    return salted.join(spans, valid, "left").select(
        *[F.col(c) for c in df.columns], *[F.col(f"__take{i}").alias(name) for i, name in enumerate(take)]
    )


def lookup_as_of_merge(df: DataFrame, dim: DataFrame, on: str, ts: str, key: str, take: Mapping[str, str]) -> DataFrame:
    """The same as `lookup_as_of`, by merging rows and versions in time order.

    Rows and versions are cut together into ranges of (key, time), and within a
    range each row takes the last version before it. A key that goes on in the
    next range hands its last version over: of such keys there are fewer than
    ranges, so what is handed over is bounded by their number. A key with any
    share of the rows is split over ranges by time, and no row meets more than
    one version, however many a key has; the price is that rows are written
    and shuffled twice. For versions whose starts grow with their numbers.
    """
    names = list(take)
    spans = gap_free(dim, key).filter(F.col(key).isNotNull() & F.col("effective_date").isNotNull())
    version = F.struct("effective_date", "valid_to", "expiry_date", *[F.col(c).alias(f"take{i}") for i, c in enumerate(take.values())])
    known = spans.select(F.col(key).alias("k"), F.col("effective_date").alias("t"), F.lit(0).alias("kind"), version.alias("version"))
    timed = F.col(on).isNotNull() & F.col(ts).isNotNull()
    rows = df.filter(timed).select(F.col(on).alias("k"), F.col(ts).alias("t"), F.lit(1).alias("kind"), F.struct(*df.columns).alias("row"))
    order = ["k", "t", "kind"]
    both = known.unionByName(rows, allowMissingColumns=True).withColumn("tie", F.monotonically_increasing_id())
    # Written, so that ranges cannot move between the two readings below.
    placed = cut(both.repartitionByRange(*order, "tie").drop("tie").withColumn("part", F.spark_partition_id()))
    last = F.last("version", ignorenulls=True)
    inside = Window.partitionBy("part", "k").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = placed.withColumn("carried", last.over(inside)).filter("kind = 1")
    long = placed.groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    steps = long.select("k", F.explode(F.sequence("lo", "hi")).alias("part"))
    ends = placed.filter("kind = 0").join(F.broadcast(long.select("k")), "k", "left_semi").groupBy("k", "part").agg(F.max_by("version", "t").alias("version"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = steps.join(ends, ["k", "part"], "left").withColumn("handed", last.over(before)).select("k", "part", "handed")
    found = merged.join(F.broadcast(handed), ["k", "part"], "left").withColumn("v", F.coalesce("carried", "handed"))
    ended = F.when(F.col("v.valid_to").isNotNull(), F.col("t") < F.col("v.valid_to")).otherwise(F.col("v.expiry_date").isNull() | (F.col("t") <= F.col("v.expiry_date")))
    out = found.select("row.*", *[F.when(ended, F.col(f"v.take{i}")).alias(name) for i, name in enumerate(names)])
    none = df.filter(~timed).select("*", *[F.lit(None).cast(out.schema[name].dataType).alias(name) for name in names])
    return out.unionByName(none)
