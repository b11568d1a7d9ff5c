"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of bounded size within a partition. Its words
become symbols, a separator closes each document, and from the suffix array
come the Burrows-Wheeler column (held in a wavelet matrix for rank queries) and
sampled suffix positions. Benchmark windows are searched backwards, all of a
block at once; occurrences are walked to a sample, mapped to documents, and
their spans merged. Words that no searched window holds share one symbol, and a
run of them is one symbol, which changes no answer and keeps the index small.

Windows travel by broadcast in blocks of a fixed number of windows; a longer
benchmark takes several passes, each over the written result of the one before.
Documents are never shuffled, so copies and shared passages make no hot group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import ALNUM, blobs_of, chunks, replaced, tidy, with_columns, word_hashes
from workmill.session import cut

_SAMPLE = 16  # distance of sampled suffix positions


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling over those not yet told apart."""
    n = len(text)
    rank = np.zeros(n + 1, np.int64)  # past the end: 0
    rank[:n] = np.unique(text, return_inverse=True)[1] + 1
    width, base = 1, int(rank.max()) + 1
    while base**2 < 1 << 62 and width < 8:  # pack a few symbols at once
        rank[:n] = rank[:n] * base + rank[np.minimum(np.arange(n) + width, n)]
        width, base = width * 2, base**2
    order = np.argsort(rank[:n], kind="stable")
    rank[order] = _dense(rank[order], np.arange(n))
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_at = np.flatnonzero(tied)
        if not len(open_at):
            return order
        part = order[open_at]
        second = rank[np.minimum(part + width, n)]
        by = np.lexsort((second, rank[part]))
        part, first, second = part[by], rank[part][by], second[by]
        order[open_at] = part
        new = np.ones(len(part), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        # A group keeps the rank of its first place, so ranks stay ordered.
        rank[part] = np.maximum.accumulate(np.where(new, open_at + 1, 0))
        width *= 2


def _dense(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted values, one plus the place where each run begins."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, places + 1, 0))


class Wavelet:
    """Rank queries on a sequence of symbols, one bit vector a level."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.zeros, self.ones = [], []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (text >> shift) & 1
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append((shift, ones))
            self.zeros.append(len(text) - int(ones[-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(place)
        for (shift, ones), zeros in zip(self.ones, self.zeros, strict=True):
            bit = ((symbol >> shift) & 1).astype(bool)
            place = np.where(bit, zeros + ones[place], place - ones[place])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return place - start


class FmIndex:
    """Backward search over one shard.

    An end mark below all symbols is added, without which the order of suffixes
    and that of rotations could differ.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        text, symbols = np.append(text + 1, 0), symbols + 1
        order = suffix_array(text)
        self.text_length = len(text)
        self.column = text[order - 1]
        self.wavelet = Wavelet(self.column, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.sampled = order % _SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern.

        Patterns are rows of symbols, right-aligned.
        """
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.text_length, np.int64)
        for back in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, -1 - back] + 1
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walked back to the nearest sample."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.column[rows[live]]
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps


def _windows(width):
    """(item_id, window) with the word hashes of each distinct window."""

    def run(batches):
        for batch in batches:
            h, at = word_hashes(blobs_of(batch, "text"), ALNUM)
            ids, out, item = batch.column("item_id").to_pylist(), [], []
            for name, a, b in zip(ids, at[:-1], at[1:], strict=True):
                for k in range(a, max(b - width, a) + 1) if b > a else ():
                    out.append(h[k : min(k + width, b)].view(np.int64))
                    item.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "window"])

    return run


def _blocks(benchmark: DataFrame, width: int, size: int):
    """Lists of (window, item ids), each of about `size` entries.

    What the driver holds at once is one block.
    """
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    entries = cut(own.mapInArrow(tidy(_windows(width)), "item_id string, window array<long>").distinct())
    count = -(-entries.count() // size)
    for k in range(count):
        yield count, entries.where(F.pmod(F.xxhash64("window"), F.lit(count)) == k).collect()


def _scan(broadcast, schema, shard_bytes):
    def run(batches):
        known, patterns, lengths, items = broadcast.value
        for batch in batches:
            texts, spans, found = blobs_of(batch, "text"), batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            n_words = []
            for i, j in chunks(texts, shard_bytes):
                n_words += _shard(texts[i:j], spans, found, i, known, patterns, lengths, items)
            new = {"n_words": n_words, "__spans": spans, "__items": found}
            yield replaced(batch, schema, {f.name: pa.array(new[f.name], f.type) for f in schema if f.name in new})

    return run


def _shard(texts, spans, found, first, known, patterns, lengths, items):
    """Search one shard; add spans and items to its documents."""
    h, at = word_hashes(texts, ALNUM)
    count = np.diff(at)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    symbol = np.where(known[place] == h, place + 2, 1)  # 1: in no window
    text = np.zeros(len(h) + len(texts) + 1, np.int64)
    begin = at[:-1] + np.arange(len(texts)) + 1  # a separator before each document
    text[np.repeat(begin - at[:-1], count) + np.arange(len(h))] = symbol
    stay = np.ones(len(text), bool)
    stay[1:] = (text[1:] != 1) | (text[:-1] != 1)
    original = np.flatnonzero(stay)  # a run of words in no window is one symbol
    index = FmIndex(text[stay], len(known) + 2)
    low, high = index.search(patterns, lengths)
    hit = np.flatnonzero(high > low)
    times = (high - low)[hit]
    rows = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start, window = original[index.locate(rows)], np.repeat(hit, times)
    doc = np.searchsorted(begin, start, side="right") - 1
    for d, where in zip(*_groups(doc), strict=True):
        own = [[int(s), int(s + n)] for s, n in zip(start[where] - begin[d], lengths[window[where]], strict=True)]
        spans[first + d] = merge_spans([*spans[first + d], *own])
        found[first + d] = sorted({*found[first + d], *(x for w in np.unique(window[where]) for x in items[w])})
    return count.tolist()


def _groups(key: np.ndarray):
    order = np.argsort(key, kind="stable")
    names, at = np.unique(key[order], return_index=True)
    return names.tolist(), np.split(order, at[1:]) if len(names) else []


def merge_spans(spans: list) -> list:
    """Half-open spans in order, touching ones as one."""
    out: list = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _packed(rows) -> tuple:
    """A block for search: known words, right-aligned symbols, lengths, items."""
    by_window: dict[tuple, list[str]] = {}
    for item, window in rows:
        by_window.setdefault(tuple(window), []).append(item)
    hashed = [np.array(w, np.int64).view(np.uint64) for w in by_window]
    known = np.unique(np.concatenate(hashed))
    lengths = np.array([len(w) for w in hashed], np.int64)
    patterns = np.zeros((len(hashed), int(lengths.max())), np.int64)
    for row, window in zip(patterns, hashed, strict=True):
        row[len(row) - len(window) :] = np.searchsorted(known, window) + 2
    return known, patterns, lengths, list(by_window.values())


def _finish(schema, keep_text):
    import re

    word = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def run(batches):
        for batch in batches:
            spans, found = batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            new = {"n_hit": [sum(b - a for a, b in s) for s in spans], "n_items": [len(x) for x in found], "contaminated": [bool(s) for s in spans]}
            new["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            if keep_text:
                new["kept"] = [_without(t, s, word) if s else t for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans, strict=True)]
            yield replaced(batch, schema, {f.name: pa.array(new[f.name], pa.binary() if f.name == "kept" else f.type).cast(f.type) for f in schema if f.name in new})

    return run


def _without(text: bytes, spans: list, word) -> bytes:
    """The text with the words of the spans, and what stands between, cut out."""
    at = [m.span() for m in word.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, texts: bool = True, block: int = 200_000, shard_bytes: int = 2 << 20) -> DataFrame:
    """Find benchmark passages in documents and cut them out.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII
    bytes. A window is `width` consecutive words of an item, or a shorter item
    whole. Adds n_words, n_hit (words inside any occurrence), n_items, the
    item ids as items_sha256 (sorted as strings, comma-joined), contaminated,
    spans (word places) and, with `texts`, kept: the text without the spans.
    Columns of these names are replaced; other columns and all rows stay.

    Null or empty text: no words, never hit; a null item text or id is no item.
    Repeated rows are judged alike. Empty benchmark: nothing is hit. `block`
    windows are searched a pass; a shard is about `shard_bytes` of text or one
    longer document.
    """
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "kept", "__spans", "__items")
    empty = F.array()
    state = docs.drop(*added).withColumns({"__spans": empty.cast("array<array<int>>"), "__items": empty.cast("array<string>"), "n_words": F.lit(0).cast("long")})
    passes = 0
    for count, rows in _blocks(benchmark, width, block):
        if not rows:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(_packed(rows))
        state = with_columns(state, "n_words long, __spans array<array<int>>, __items array<string>", lambda schema, shared=shared: _scan(shared, schema, shard_bytes))
        passes += 1
        if count > 1:
            state = cut(state)
    if not passes:
        state = with_columns(state, "n_words long", _count_words)
    out = with_columns(state, "n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", kept string" * texts, lambda schema: _finish(schema, texts))
    return out.withColumnRenamed("__spans", "spans").drop("__items")


def _count_words(schema):
    def run(batches):
        for batch in batches:
            n = [len((t or b"").translate(ALNUM).split()) for t in blobs_of(batch, "text")]
            yield replaced(batch, schema, {"n_words": pa.array(n, pa.int64())})

    return run
