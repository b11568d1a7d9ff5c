"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.session import configure
from workmill.sources.projection import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2000-01-01 10:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
DONE = {"completed": ("done",), "closed": ("done", "cancelled")}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, the forms two engines share."""

    def column(field):
        kind = field.dataType.typeName()
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        if kind == "date":
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[column(f) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register `fn(inputs)` under `name`, with its oracle if SQL can say it."""

    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(fn(Inputs(configure(spark), folder)))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def dec(expr: str, scale: int = 2) -> str:
    """SQL for a decimal of that scale, read as a double."""
    return f"CAST(CAST({expr} AS DECIMAL(30,{scale})) AS DOUBLE)"


def half_up(num: str, den: str) -> str:
    """SQL for num / den of two integers, rounded to 2 digits half away from
    zero in integer arithmetic, read as a double; NULL where den is 0."""
    n, d = f"CAST({num} AS BIGINT)", f"CAST(nullif({den}, 0) AS BIGINT)"
    return f"CAST(sign({n}) * ((200 * abs({n}) + {d}) // (2 * {d})) AS DOUBLE) / 100"


def load() -> None:
    """Fill the registry."""
    from workmill.plans import registered_logs, registered_reports, registered_stored, registered_warehouse  # noqa: F401
