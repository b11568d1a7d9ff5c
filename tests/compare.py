"""Compare a registered query with its oracle: names, types, rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("WORKMILL_TESTDATA", "/root/testdata")

# Spark type -> the oracle's type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9) + 0.0
    return value


def differences(df, con, sql: str) -> list[str]:
    """Reasons the two disagree; empty when they agree."""
    cursor = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    expected = cursor.fetchall()
    ours = dict(df.dtypes)
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} vs {sorted(theirs)}"]
    names = sorted(ours)
    wrong = [(n, ours[n], theirs[n]) for n in names if TYPES.get(ours[n]) != theirs[n]]
    at = [list(theirs).index(n) for n in names]
    a = Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())
    b = Counter(tuple(_cell(r[i]) for i in at) for r in expected)
    out = [f"types {wrong}"] if wrong else []
    if a != b:
        out.append(f"rows {a.total()} vs {b.total()}; ours only {list((a - b))[:3]}; oracle only {list((b - a))[:3]}; {names}")
    return out
