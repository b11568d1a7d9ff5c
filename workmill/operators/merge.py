"""Keyed update of a table from another one, as a pure function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.functions.moments import at
from workmill.functions.scalars import any_distinct, changed


def merge_update(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    set_cols: Sequence[str],
    tracked: Sequence[str] | None = None,
    keep_old_when_null: Sequence[str] = (),
    as_of=None,
    mark: str | None = None,
) -> DataFrame:
    """UPDATE target SET ... FROM updates WHERE keys match [and tracked differ].

    With `tracked`, a matched row is updated only where one of those columns
    differs null-safely. Columns in `keep_old_when_null` keep their value when
    the update holds NULL. With `as_of`, changed rows get updated_at = as_of.
    `mark` names a boolean column telling which rows were updated.
    `updates` holds at most one row per key.
    """
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in dict.fromkeys([*set_cols, *(tracked or ())])])
    joined = target.join(new, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    if tracked is not None:
        hit = hit & any_distinct((F.col(c), F.col(f"__new_{c}")) for c in tracked)
    marked = joined.withColumn("__hit", hit)
    out = []
    for field in target.schema:
        c = field.name
        value = F.col(c)
        if c in set_cols:
            incoming = F.col(f"__new_{c}").cast(field.dataType)
            if c in keep_old_when_null:
                incoming = F.coalesce(incoming, value)
            value = F.when(F.col("__hit"), incoming).otherwise(value)
        elif c == "updated_at" and as_of is not None:
            value = F.when(F.col("__hit"), at(as_of)).otherwise(value)
        out.append(value.alias(c))
    if mark:
        out.append(F.col("__hit").alias(mark))
    return marked.select(*out)


def diff_kinds(old: DataFrame, new: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """(key, kind) with kind in new, deleted, changed, unchanged."""
    a = old.select(F.col(key).alias("ka"), *tracked).alias("a")
    b = new.select(F.col(key).alias("kb"), *tracked).alias("b")
    kind = (
        F.when(F.col("ka").isNull(), "new")
        .when(F.col("kb").isNull(), "deleted")
        .when(changed("a", "b", tracked), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), kind.alias("kind"))
