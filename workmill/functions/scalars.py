"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_from(a: Column, b: Column) -> Column:
    """Null-safe inequality: NULL equals NULL and differs from any value."""
    return ~a.eqNullSafe(b)


def any_distinct(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """True where any pair differs null-safely."""
    return reduce(or_, (distinct_from(a, b) for a, b in pairs), F.lit(False))


def changed(left: str, right: str, names: Iterable[str]) -> Column:
    """True where any of `names` differs between two join aliases."""
    return any_distinct((F.col(f"{left}.{n}"), F.col(f"{right}.{n}")) for n in names)


def ratio(part: Column, whole: Column, digits: int = 2, precision: int = 12) -> Column:
    """100 * part / whole as a decimal, NULL where whole is zero."""
    share = part.cast("decimal(20,4)") * F.lit(100) / F.nullif(whole.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    return F.round(share, digits).cast(f"decimal({precision},{digits})")


def amount(value: Column, precision: int = 10, scale: int = 2) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def mean(value: Column, precision: int = 10, scale: int = 2) -> Column:
    """Average as a decimal, rounded once (Spark's own average of a decimal
    keeps four more digits, and rounding that again can differ)."""
    count = F.nullif(F.count(value), F.lit(0)).cast("decimal(18,0)")
    return (F.sum(value).cast("decimal(20,6)") / count).cast(f"decimal({precision},{scale})")


def total(value: Column) -> Column:
    """sum(coalesce(x, 0)): NULL inputs count as nothing."""
    return F.sum(F.coalesce(value, F.lit(0)))


def asc(name: str | Column) -> Column:
    """Ascending with NULLs last, the order the source model's reports use."""
    return (F.col(name) if isinstance(name, str) else name).asc_nulls_last()


def desc(name: str | Column) -> Column:
    """Descending with NULLs first."""
    return (F.col(name) if isinstance(name, str) else name).desc_nulls_first()


def size_pretty(size: Column) -> Column:
    """Human-readable bytes: the largest unit that keeps at least 10 of it.

    One bit below the unit is kept for rounding, and halves round up.
    """
    size = size.cast("bigint")
    text = F.when(F.abs(size) < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes")))
    units = ("kB", "MB", "GB", "TB", "PB")
    for i, unit in enumerate(units):
        halves = F.floor(size / F.lit(float(2 ** (10 * (i + 1) - 1)))).cast("bigint")
        rounded = F.call_function("div", halves + F.signum(halves).cast("bigint"), F.lit(2))
        label = F.concat(rounded.cast("string"), F.lit(f" {unit}"))
        if unit == units[-1]:
            return text.otherwise(label)
        text = text.when(F.abs(halves) < 20 * 1024 - 1, label)
    return text


def padded_name(day: Column, pattern: str) -> Column:
    """Day or month name blank-padded to nine characters."""
    return F.rpad(F.date_format(day, pattern), 9, " ")


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def json_text(doc: Column, key: str) -> Column:
    """Value of a top-level key as text, NULL where the key is missing."""
    return F.get_json_object(doc, f"$.{key}")
