"""Slowly changing dimensions that keep every version (type 2)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from workmill.functions.moments import at, parse
from workmill.functions.scalars import any_distinct

KINDS = ("new", "changed", "deleted", "unchanged", "returned")


@dataclass(frozen=True)
class Dimension:
    """What a version-keeping dimension tracks.

    A change in a `tracked` column starts a new version; `payload` columns are
    copied when a version starts and never start one themselves.
    """

    key: str
    surrogate: str
    tracked: tuple[str, ...]
    payload: tuple[str, ...] = ()


USERS = Dimension(
    "user_id",
    "user_key",
    ("email", "first_name", "last_name", "role", "status"),
    ("username", "department", "manager_id", "hire_date"),
)
PROJECTS = Dimension(
    "project_id",
    "project_key",
    (
        "project_name",
        "project_code",
        "description",
        "status",
        "priority",
        "start_date",
        "end_date",
        "budget",
        "client_name",
        "manager_id",
    ),
)
TASK_STATUS = Dimension("status_id", "status_key", ("status_name", "status_category", "is_active"))
PRIORITY = Dimension("priority_id", "priority_key", ("priority_name", "priority_level", "is_active"))


def first_version(src: DataFrame, like: DataFrame | None, spec: Dimension, as_of, batch_id: str | None = None) -> DataFrame:
    """Every source row as version 1 (surrogate keys left NULL), in the columns
    of `like` if given. The tenant column is carried along where there is one."""
    attributes = [c for c in (*spec.tracked, *spec.payload) if c in src.columns]
    out = src.select(
        F.lit(None).cast("int").alias(spec.surrogate),
        spec.key,
        *attributes,
        *[c for c in ("organization_id",) if c in src.columns],
        at(as_of).alias("effective_date"),
        F.lit(None).cast("timestamp_ntz").alias("expiry_date"),
        F.lit(True).alias("is_current"),
        F.lit(1).alias("version_number"),
        F.lit("OLTP").alias("source_system"),
        F.lit(batch_id).cast("string").alias("etl_batch_id"),
        at(as_of).alias("etl_timestamp"),
    )
    if like is None:
        return out
    known = set(out.columns)
    return out.select(
        *[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema]
    )


def _matched(dim: DataFrame, src: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """Current versions (d_*) against the source (s_*), with `kind`.

    Rows of older versions never enter this join. Their keys are needed only to
    tell a brand-new entity from one that was deleted and came back, and are
    reduced to one row per key before they meet the source. Both joins are on
    the plain key column, so the source is shuffled once for the two.
    """
    past = (
        dim.filter(~F.coalesce("is_current", F.lit(False)))
        .groupBy(F.col(key).alias("past_key"))
        .agg(F.max("version_number").alias("past_version"))
    )
    s = src.select(F.lit(True).alias("in_source"), *[F.col(c).alias(f"s_{c}") for c in src.columns])
    s = s.join(past, F.col(f"s_{key}") == F.col("past_key"), "left")
    d = dim.filter(F.col("is_current")).select(
        F.lit(True).alias("in_dim"), *[F.col(c).alias(f"d_{c}") for c in dim.columns]
    )
    kind = (
        F.when(F.col("in_source").isNull(), "deleted")
        .when(F.col("in_dim").isNull() & F.col("past_key").isNotNull(), "returned")
        .when(F.col("in_dim").isNull(), "new")
        .when(any_distinct((F.col(f"d_{c}"), F.col(f"s_{c}")) for c in tracked), "changed")
        .otherwise("unchanged")
    )
    return d.join(s, F.col(f"d_{key}") == F.col(f"s_{key}"), "full").withColumn("kind", kind)


def _versions(
    dim: DataFrame, src: DataFrame, spec: Dimension, as_of, batch_id: str | None, reopen: bool, source_system: str, observe: Observation | None
) -> DataFrame:
    """Keys with their `kind` and `rows`, an array of the one or two versions a
    key has after the load: the stored one, ended or not, and the started one."""
    attributes = set(spec.tracked) | set(spec.payload)
    tracked = [c for c in spec.tracked if c in dim.columns and c in src.columns]
    kind = F.col("kind")
    ended = kind.isin("deleted", "changed")
    starts = kind.isin("new", "changed") | (F.lit(reopen) & (kind == "returned"))

    def kept(field):
        old = F.col(f"d_{field.name}")
        end = {
            "expiry_date": at(parse(as_of) - timedelta(seconds=1)),
            "is_current": F.lit(False),
            "etl_timestamp": at(as_of),
        }.get(field.name)
        value = old if end is None else F.when(ended, end).otherwise(old)
        return value.cast(field.dataType).alias(field.name)

    def started(field):
        name = field.name
        fixed = {
            "effective_date": at(as_of),
            "is_current": F.lit(True),
            "version_number": F.coalesce(F.col("d_version_number"), F.col("past_version"), F.lit(0)) + 1,
            "source_system": F.lit(source_system),
            "etl_batch_id": F.lit(batch_id),
            "etl_timestamp": at(as_of),
        }
        if name in fixed:
            value = fixed[name]
        elif (name == spec.key or name in attributes or name == "organization_id") and name in src.columns:
            value = F.col(f"s_{name}")
        else:
            value = F.lit(None)
        return value.cast(field.dataType).alias(name)

    rows = F.array(
        F.when(F.col("in_dim").isNotNull(), F.struct(*[kept(f) for f in dim.schema])),
        F.when(starts, F.struct(*[started(f) for f in dim.schema])),
    )
    pairs = _matched(dim, src, spec.key, tracked)
    if observe is not None:
        pairs = pairs.observe(observe, *[F.count_if(kind == k).alias(k) for k in KINDS])
    return pairs.select("kind", F.filter(rows, lambda r: r.isNotNull()).alias("rows"))


def scd2_merge(
    dim: DataFrame,
    src: DataFrame,
    spec: Dimension,
    as_of,
    batch_id: str | None = None,
    reopen: bool = False,
    source_system: str = "OLTP",
    observe: Observation | None = None,
) -> DataFrame:
    """The dimension after one load of `src` at `as_of`.

    - A current version whose entity is gone or changed ends one second before
      `as_of`.
    - A changed entity gets the next version, a new one version 1.
    - An entity deleted earlier that is back gets a version only with
      `reopen=True`; the loader this follows never reopens one.

    One join decides both the ended and the started version of a key, and each
    pair is then expanded to its one or two rows. New rows have a NULL
    surrogate; `functions.keys.fill_keys` numbers them. `observe` receives the
    keys per kind when the result is written.
    """
    pairs = _versions(dim, src, spec, as_of, batch_id, reopen, source_system, observe)
    merged = pairs.select(F.explode("rows").alias("r")).select("r.*")
    history = dim.filter(~F.coalesce("is_current", F.lit(False)))
    return history.unionByName(merged)


def scd2_changes(
    dim: DataFrame,
    src: DataFrame,
    spec: Dimension,
    as_of,
    batch_id: str | None = None,
    reopen: bool = False,
    source_system: str = "OLTP",
    observe: Observation | None = None,
) -> DataFrame:
    """Only the versions a load ends or starts, as `scd2_merge` has them.

    Ended ones are not current and keep their surrogate, started ones are
    current without one. Keys that stay as they are give no row.
    """
    pairs = _versions(dim, src, spec, as_of, batch_id, reopen, source_system, observe)
    return pairs.filter(F.col("kind") != "unchanged").select(F.explode("rows").alias("r")).select("r.*")


def scd2_kinds(dim: DataFrame, src: DataFrame, spec: Dimension) -> DataFrame:
    """(key, kind) with kind in new, changed, deleted, unchanged, returned."""
    tracked = [c for c in spec.tracked if c in dim.columns and c in src.columns]
    key = spec.key
    return _matched(dim, src, key, tracked).select(F.coalesce(f"d_{key}", f"s_{key}").alias(key), "kind")


def scd2_counts(dim: DataFrame, src: DataFrame, spec: Dimension) -> DataFrame:
    """Rows per kind: the counters of a load."""
    return scd2_kinds(dim, src, spec).groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"))


def scd2_problems(dim: DataFrame, key: str) -> DataFrame:
    """Keys with more than one current version or a gap in version numbers.

    Plain aggregates per key (combined before the shuffle), no window: numbers
    have no gap exactly if all are distinct and span their own count.
    """
    per_version = dim.groupBy(key, "version_number").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("is_current").alias("current_copies")
    )
    per_key = per_version.groupBy(key).agg(
        F.sum("copies").alias("versions"),
        F.sum("current_copies").alias("current_versions"),
        F.count(F.lit(1)).alias("numbers"),
        (F.max("version_number") - F.min("version_number") + 1).alias("span"),
    )
    gap = (F.col("numbers") != F.col("versions")) | (F.col("span") != F.col("numbers"))
    return per_key.filter((F.col("current_versions") > 1) | gap).select(
        key, "versions", "current_versions", gap.alias("has_gap")
    )
