"""Questions about logs of operations, usage and waiting."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.functions.moments import at, parse, seconds_between
from workmill.functions.scalars import asc, desc, mean, ratio, size_pretty


def slowest(
    log: DataFrame, op: str, start: str, end: str, hit: Column, k: int = 10, leave_out: str | None = None
) -> DataFrame:
    """Top `k` operations by mean seconds, with calls, total and hit percent.

    `hit` is true, false, or NULL for a call that counts as neither;
    `leave_out` is a LIKE pattern of operations to skip.
    """
    took = seconds_between(F.col(start), F.col(end))
    rows = log if leave_out is None else log.filter(~F.col(op).like(leave_out))
    hits, misses = F.count_if(hit), F.count_if(~hit)
    grouped = rows.groupBy(op).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(took), F.lit(0)).cast("decimal(24,6)").alias("total_seconds"),
        mean(took, 20, 4).alias("mean_seconds"),
        ratio(hits, hits + misses).alias("hit_percent"),
    )
    return grouped.orderBy(F.desc_nulls_last("mean_seconds"), asc(op)).limit(k)


def throughput(log: DataFrame, by: str, hit: Column, changed: Column, leave_out: Sequence[str] = ()) -> DataFrame:
    """Per source: operations, changed rows, hits, misses, hit ratio."""
    rows = log.filter(~F.col(by).isin(*leave_out)) if leave_out else log
    hits, misses = F.count_if(hit), F.count_if(~hit)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.coalesce(F.sum(changed), F.lit(0)).cast("bigint").alias("total_changes"),
        hits.alias("hits"),
        misses.alias("misses"),
        ratio(hits, hits + misses).alias("hit_ratio"),
    )


def over_threshold(log: DataFrame, by: str, dead: Column, base: int = 50, factor: str = "0.2") -> DataFrame:
    """Groups whose dead rows exceed base + factor * rows, worst share first."""
    grouped = log.groupBy(by).agg(F.count_if(~dead).alias("live_rows"), F.count_if(dead).alias("dead_rows"))
    rows = F.col("live_rows") + F.col("dead_rows")
    limit = (F.lit(base) + F.lit(factor).cast("decimal(6,3)") * rows.cast("decimal(18,0)")).cast("decimal(20,3)")
    share = F.when(rows > 0, ratio(F.col("dead_rows"), rows)).otherwise(F.lit(0).cast("decimal(12,2)"))
    return (
        grouped.withColumns({"threshold": limit, "dead_ratio": share})
        .filter(F.col("dead_rows") > F.col("threshold"))
        .orderBy(desc("dead_ratio"), asc(by))
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str], member: str, size: Column, list_length: int = 1000) -> DataFrame:
    """Groups of more than one row: member list, member count, total size.

    Groups up to `list_length` members are one row with the whole list. A
    larger one is several rows, `part` 0, 1, ..., each with a share of the
    list, so no group has to fit one row or one task; count and size are those
    of the whole group on every row. No member is left out.
    """
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("member_count"), F.sum(size).cast("bigint").alias("total_size"))
    repeated = sums.filter(F.col("member_count") > 1)
    parts = F.ceil(F.col("member_count") / F.lit(list_length))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    members = df.select(*keys, F.col(member).alias("__member")).alias("m")
    placed = members.join(repeated.alias("g"), condition).select(
        *[F.col(f"m.{k}").alias(k) for k in keys],
        "member_count",
        "total_size",
        F.pmod(F.xxhash64("__member"), parts).cast("int").alias("part"),
        "__member",
    )
    return placed.groupBy(*keys, "part", "member_count", "total_size").agg(
        F.sort_array(F.collect_list("__member")).alias("members")
    )


def low_use(items: DataFrame, item: str, uses: DataFrame, used: str, other: Column, below: int = 50) -> DataFrame:
    """Items used fewer than `below` times, never used included.

    `other` marks uses of another kind; the share of plain uses is NULL where
    an item has no use at all.
    """
    counted = uses.groupBy(F.col(used).alias("__used")).agg(
        F.count_if(~other).alias("__plain"), F.count_if(other).alias("__other")
    )
    rows = items.join(counted, F.col(item) == F.col("__used"), "left")
    plain, rest = F.coalesce("__plain", F.lit(0)), F.coalesce("__other", F.lit(0))
    out = rows.select(item, plain.alias("use_count"), ratio(plain, plain + rest).alias("use_ratio"))
    return out.filter(F.col("use_count") < below).orderBy(asc("use_ratio"), asc("use_count"), asc(item))


def activity_counts(log: DataFrame, by: Sequence[str], actor: str, own) -> DataFrame:
    """Counts by several dimensions, leaving out one's own activity."""
    others = log.filter(F.col(actor) != F.lit(own))
    return (
        others.groupBy(*by).agg(F.count(F.lit(1)).alias("activity_count")).orderBy(desc("activity_count"), *[asc(c) for c in by])
    )


def running_longer(log: DataFrame, start: str, as_of, minutes: int = 5, idle: Column | None = None) -> DataFrame:
    """Unfinished work older than `minutes`, longest first.

    The age test compares the start column with a literal, so it reaches the
    scan; the duration is computed for what is left.
    """
    rows = log.filter(F.col(start) < at(parse(as_of) - timedelta(minutes=minutes)))
    if idle is not None:
        rows = rows.filter(~idle)
    took = seconds_between(F.col(start), at(as_of))
    return rows.withColumn("duration_seconds", took).orderBy(desc("duration_seconds"))


def waiting_requests(locks: DataFrame, pid: str, resource: Sequence[str], granted: str) -> DataFrame:
    """One row per waiting request: how many others hold what it waits for.

    The resource is compared null-safely on every part. Holders are counted per
    resource and per (resource, holder) first, so the work and the result stay
    linear where many wait for one resource that many hold. A request's own
    holdings do not block it. `blocking_pid` is one of the blockers (the
    smallest, or the largest where the smallest is the request itself).
    `blockers_of` lists every blocker of one process.
    """
    held = locks.filter(F.col(granted)).groupBy(*resource, pid).agg(F.count(F.lit(1)).alias("__mine"))
    per_resource = held.groupBy(*resource).agg(
        F.count(F.lit(1)).alias("__holders"), F.min(pid).alias("__first"), F.max(pid).alias("__last")
    )
    w = locks.filter(~F.col(granted)).alias("w")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in resource]
    found = w.join(per_resource.alias("h"), _all(same)).select("w.*", "__holders", "__first", "__last").alias("w")
    mine = [F.col(f"w.{c}").eqNullSafe(F.col(f"o.{c}")) for c in resource] + [F.col(f"w.{pid}") == F.col(f"o.{pid}")]
    rows = found.join(held.alias("o"), _all(mine), "left")
    others = F.col("__holders") - F.when(F.col("__mine").isNull(), 0).otherwise(1)
    one = F.when(F.col("__first") != F.col(f"w.{pid}"), F.col("__first")).otherwise(F.col("__last"))
    return rows.select("w.*", others.alias("blocker_count"), one.alias("blocking_pid")).filter(
        F.col("blocker_count") > 0
    ).drop("__holders", "__first", "__last")


def blockers_of(locks: DataFrame, waiting_pid, pid: str, resource: Sequence[str], granted: str) -> DataFrame:
    """Every (blocked, blocking) pair of one waiting process."""
    w = locks.filter(~F.col(granted) & (F.col(pid) == F.lit(waiting_pid))).select(pid, *resource).distinct().alias("w")
    h = locks.filter(F.col(granted)).select(pid, *resource).distinct().alias("h")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in resource] + [F.col(f"w.{pid}") != F.col(f"h.{pid}")]
    return w.join(h, _all(same)).select(
        F.col(f"w.{pid}").alias("blocked_pid"),
        F.col(f"h.{pid}").alias("blocking_pid"),
        *[F.col(f"w.{c}").alias(c) for c in resource],
    )


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def share_of_total(df: DataFrame, by: str, value: Column, digits: int = 1) -> DataFrame:
    """Each group's percentage of the grand total.

    The total is a scalar subquery over the grouped rows, not a join.
    """
    grouped = df.groupBy(by).agg(F.sum(value).alias("amount"))
    whole = grouped.agg(F.sum("amount")).scalar()
    return grouped.withColumn("percent", ratio(F.col("amount"), whole, digits)).orderBy(desc("amount"), asc(by))


def lag_seconds(df: DataFrame, ts: str, as_of) -> DataFrame:
    """Seconds from the latest event to `as_of`."""
    return df.agg(F.max(ts).alias("latest")).select("latest", seconds_between(F.col("latest"), at(as_of)).alias("lag_seconds"))


def size_report(df: DataFrame, by: str, whole: Column, part: Column) -> DataFrame:
    """Total, part and remainder per group, as numbers and readable text."""
    grouped = df.groupBy(by).agg(
        F.sum(whole).cast("bigint").alias("total_bytes"), F.sum(part).cast("bigint").alias("part_bytes")
    )
    rest = F.col("total_bytes") - F.col("part_bytes")
    return grouped.select(
        by,
        "total_bytes",
        "part_bytes",
        rest.alias("other_bytes"),
        size_pretty(F.col("total_bytes")).alias("total_size"),
        size_pretty(F.col("part_bytes")).alias("part_size"),
        size_pretty(rest).alias("other_size"),
    ).orderBy(desc("total_bytes"), asc(by))


def table_activity(log: DataFrame, by: str, ts: str, inserted: Column, updated: Column, deleted: Column) -> DataFrame:
    """Per table: row changes by kind, dead rows, last change; most dead first."""
    grouped = log.groupBy(by).agg(
        F.count_if(inserted).alias("inserted_rows"),
        F.count_if(updated).alias("updated_rows"),
        F.count_if(deleted).alias("deleted_rows"),
        F.count_if(updated | deleted).alias("dead_rows"),
        F.max(ts).alias("last_change"),
    )
    return grouped.orderBy(desc("dead_rows"), asc(by))
