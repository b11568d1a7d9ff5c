"""Best-fit packing of token sequences by large-item matching.

Method: only lengths matter to a packing, and there are at most `capacity` of
them. The driver plans over the histogram of lengths, never over documents:
pieces above a third of the capacity (at most two fit a bin) are matched
greedily, the longest with the longest that still fits; smaller ones go,
longest first, where the smallest gap takes them. The plan is a list of
placements, each for a run of pieces of one length and a run of bins. A piece's
rank within its length follows from counts per partition, so no length, however
common, passes through one task.

Ids are those of the tokenizer file. They are cached per unit of white space
and what follows, at which the tokenizer's splitting rule always breaks, and new
units are encoded by a faster library over the file's own vocabulary, where a
probe shows the same ids; else by the tokenizer. A cache has a bounded number of
units.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmill.llm.common import chunks, release, tidy
from workmill.session import cut

# The characters Unicode calls white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CACHE = 300_000  # parts whose ids a worker keeps, about 70 MB


# The published splitting rule of this vocabulary.
_RULE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's the 1st of 20 days,  they'll say\n\n\tnaïve — ünïcode ¿ñ? 中文 ½ 🙂 ... (x_y) don't "


def _same_vocabulary(path: str, tokenizer):
    """A faster encoder over the file's vocabulary, if it is a byte-level BPE
    whose ids follow its merges, and the strings it must not see.

    None where a probe text does not give the tokenizer's own ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    try:
        ranks = {bytes(to_byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=_RULE, mergeable_ranks=ranks, special_tokens={})
        same = fast.encode_ordinary(_PROBE) == tokenizer.encode(_PROBE, add_special_tokens=False).ids
    except (KeyError, ValueError, AttributeError):
        same = False
    return (fast if same else None), special


class _Encoder(dict):
    """Token ids of whole texts, as little-endian 32-bit numbers.

    Maps parts to their ids; what it does not have yet is encoded when asked for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.fast, special = _same_vocabulary(path, self.tokenizer)
        self.is_odd = re.compile("|".join(map(re.escape, special)) or "(?!)").search

    @staticmethod
    def _units(text: str) -> list[str]:
        """Parts that the tokenizer takes apart anyway.

        It breaks before the last character of white space, so with single
        blanks only, each blank begins a part of its own. The blank is left
        out here; what begins the text is marked by one that cannot occur.
        """
        if "  " in text:
            return ["  " + u for u in _UNITS.findall(text)]
        first, *rest = text.split(" ")
        return ["  " + first, *rest]

    @staticmethod
    def _text(unit: str) -> str:
        return unit[2:] if unit.startswith("  ") else " " + unit

    def __missing__(self, unit: str) -> bytes:
        text = self._text(unit)
        if self.fast is None or self.is_odd(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        self[unit] = coded = array("I", ids).tobytes()
        return coded

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self) > _CACHE:
            self.clear()
        return [b"".join(map(self.__getitem__, self._units(t))) for t in texts]


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One a Python worker, kept from task to task."""
    return _Encoder(path)


def _pieces(path: str, capacity: int, end: int):
    """One row per piece: its length, checksum, task and rank within both."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task, seen, close = _encoder(path), TaskContext.get().partitionId(), defaultdict(int), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j in chunks(texts, 1 << 20):
                rows = []
                for name, ids_of in zip(ids[i:j], encode([t or "" for t in texts[i:j]]), strict=True):
                    whole = ids_of + close
                    n, at = len(whole) // 4, 0
                    length = n if n <= capacity else n % capacity or capacity
                    piece = 0
                    while at < n:
                        rows.append((name, piece, at, length, zlib.crc32(whole[4 * at : 4 * (at + length)]), task, seen[length]))
                        seen[length] += 1
                        at, piece, length = at + length, piece + 1, capacity
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "place")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))
        encode.clear()  # the worker lives on in later steps

    return run


class _Bins:
    """Runs of equal bins by the gap they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.by_gap, self.plan = capacity, 0, defaultdict(list), []
        self.used: dict[int, int] = defaultdict(int)

    def _put(self, length: int, bins: tuple[int, int], offset: int) -> None:
        size = bins[1] - bins[0]
        self.plan.append((length, self.used[length], self.used[length] + size, bins[0], offset))
        self.used[length] += size

    def open(self, lengths: list[int], count: int) -> None:
        """`count` new bins, each with pieces of these lengths."""
        if count:
            bins, offset = (self.count, self.count + count), 0
            self.count += count
            for length in lengths:
                self._put(length, bins, offset)
                offset += length
            self.by_gap[self.capacity - offset].append(bins)

    def best_fit(self, length: int, count: int) -> int:
        """Fill the smallest gaps that take the length; what is left over."""
        while count:
            gap = next((g for g in range(length, self.capacity + 1) if self.by_gap[g]), None)
            if gap is None:
                return count
            first, last = self.by_gap[gap].pop()
            if last - first > count:
                self.by_gap[gap].append((first + count, last))
                last = first + count
            self._put(length, (first, last), self.capacity - gap)
            self.by_gap[gap - length].append((first, last))
            count -= last - first
        return 0


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Placements (length, first rank, end rank, first bin, offset) and the number of bins.

    Its size depends on the number of different lengths, not on that of pieces.
    """
    bins, left = _Bins(capacity), dict(histogram)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= capacity - length and left[m] - (m == length) > 0), None)
            if mate is None:
                bins.open([length], left[length])
                left[length] = 0
            else:
                count = left[length] // 2 if mate == length else min(left[length], left[mate])
                bins.open([length, mate], count)
                left[length] -= count
                left[mate] -= count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        over = bins.best_fit(length, left[length])
        fit = capacity // length
        bins.open([length] * fit, over // fit)
        bins.open([length] * (over % fit), int(over % fit > 0))
    return bins.plan, bins.count


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of all documents and their place in sequences of `capacity` tokens.

    A document is its token ids and then `end`. Longer ones are cut into
    pieces of `capacity`; the first may be shorter. Returns doc_id, piece,
    start, length, ids_crc32, sequence_id, offset. Pieces lie gapless from 0 in
    each sequence.

    Null or empty text: the end token alone. Each row counts for itself, also
    with a null or repeated doc_id. No rows: no rows. `tokenizer` is the path
    of a tokenizer file that every machine has.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    pieces = cut(narrow.mapInArrow(tidy(_pieces(tokenizer, capacity, end)), schema))
    release(spark)
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    plan, _ = plan_bins(histogram, capacity)
    places = spark.createDataFrame(plan, "length long, first long, last long, bin long, offset long")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    # Bounded by the plan, whatever the number of documents.
    placed = ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).drop(places.length)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
