"""Words, window hashes and small Spark helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from workmill.session import discard, release  # noqa: F401

_BYTES = bytes(range(256))
LOWER = _BYTES.lower()  # A-Z lower-cased, every other byte kept
# Lower-cased, and what is no ASCII digit, letter or non-ASCII byte made a blank.
ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)


def chunks(blobs: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about `limit` bytes; a longer text is its own run."""
    start = held = 0
    for i, blob in enumerate(blobs):
        size = len(blob or b"")
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(blobs):
        yield start, len(blobs)


def words(blob: bytes | None, table: bytes | None = None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), after `table`."""
    if not blob:
        return []
    return (blob.translate(table) if table else blob).split()


def word_hashes(blobs: list[bytes], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin."""
    flat: list[bytes] = []
    at = [0]
    for blob in blobs:
        flat += words(blob, table)
        at.append(len(flat))
    if not flat:
        return np.zeros(0, np.uint64), np.array(at)
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=False), np.array(at)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Hash of the k words from each place on; shorter than `h` by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(factor) + h[j : j + n]
    return _mix(out)


def within(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where k words of one text begin, and the text of each."""
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(at[-1])
    ok = place + k <= at[1:][text]
    return place[ok], text[ok]


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    at = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def blobs_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text or binary column as bytes; null stays None."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def replaced(batch: pa.RecordBatch, schema: pa.Schema, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch under `schema`, with some columns new."""
    return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else batch.column(f.name) for f in schema], schema=schema)


def tidy(run: Callable) -> Callable:
    """A batch function after which its worker gives free memory back.

    Workers live on from step to step; without this each keeps the most that
    any step before has needed.
    """

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return whole


def with_columns(df: DataFrame, added: str, make: Callable, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Run a batch function that adds columns and passes the others through.

    Columns of the same names are replaced. `make` gets the Arrow schema of the
    result and returns the function.
    """
    new = StructType.fromDDL(added).fields
    old = df.drop(*dropped, *[f.name for f in new])
    schema = StructType([*old.schema.fields, *new])
    return df.mapInArrow(tidy(make(to_arrow_schema(schema))), schema)


def distinct_sample(docs: DataFrame, by: str, sample: int, seed: int, bound: int) -> tuple[dict, DataFrame]:
    """Distinct texts of each value of `by`, and about `sample` of them by value.

    Rows have `text` and `by`, no nulls. Texts are told apart by a hash and drawn by
    it, so copies count once whether drawn or not; copies of drawn texts combine
    before the shuffle. More than `bound` values are an error.
    """
    known = docs.select("text", by, F.xxhash64("text", F.lit(seed)).alias("_h"))
    sizes = {r[0]: r[1] for r in rows_at_most(known.select(by, "_h").distinct().groupBy(by).count(), bound)}
    if not sizes:
        return sizes, docs.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for value, n in sizes.items() for x in (value, min(1.0, sample / n))]), F.col(by))
    drawn = known.where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    return sizes, drawn.groupBy(by, "_h").agg(F.first("text").alias("text")).select("text", by)


def rows_at_most(df: DataFrame, bound: int) -> list:
    """Collect a result whose size is bounded; more rows than that is a bug."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows")
    return rows
