"""Quality rules: word counts, and perplexity under a modified Kneser-Ney model.

The model predicts each byte of a text from the four before it. Spark counts
all five-byte runs of the texts that train it; orders 4 to 1 follow as numbers
of distinct left neighbours, discounts from the counts of counts, and each order
is interpolated with the next lower one by joins. Probabilities and weights of
contexts are stored under 64-bit hashes of language, order and bytes, sorted,
and scoring looks them up by binary search, each distinct run of a few megabytes
once.

Texts train that pass the base rules and have at most one symbol to ten words,
all of them. Each language has two models, one of the texts with an even hash and one of
the others, and a text is scored by the one that it (and its exact copies) did
not train, so that rare strings cannot vouch for themselves. The bands are, by
language, quantiles of the bits a byte of the distinct training texts.

Probabilities are fixed-point numbers and their sums integers, so results do
not depend on how rows are dealt. The model is broadcast in slices of at most
about `bound` entries, cut by language and context; each slice costs a scan, and
sums by text are added up. A slice holds all that a place looks up.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmill.llm.common import _mix, blobs_of, chunks, discard, replaced, rolling, tidy, with_columns, within, word_hashes
from workmill.session import cut

ORDER = 5
_PAD = bytes(ORDER - 1)  # before a text; byte 0 does not occur in one
_ONE = 1 << 16  # a bit, in stored numbers
_UNSEEN = -8 * _ONE  # a byte of which nothing is known
_PIECE = 1 << 21
_BUCKETS = 1 << 12
_FACTOR = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
# White space (and byte 0) as blanks, digits as one.
_TABLE = bytes(0x20 if b == 0 or b in _SPACE else 0x30 if chr(b) in "0123456789" else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256), list(_SPACE))
_IS_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of the base rules; a null text has none."""
    blobs = [b or b"" for b in blobs]
    h, at = word_hashes(blobs)
    place, text = within(at, 3)
    three = rolling(h, 3, _FACTOR)[place] if len(place) else np.zeros(0, np.uint64)
    order = np.lexsort((three, text))
    place, text, three = place[order], text[order], three[order]
    same = (three[1:] == three[:-1]) & (text[1:] == text[:-1])
    again = np.append(same, False) | np.insert(same, 0, False)
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[place[again[: len(place)]] + k] = True
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)

    def total(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts]).astype(np.int64)

    lines = []
    for blob in blobs:
        some = [line for line in blob.split(b"\n") if line.strip()]
        lines.append(len(some) - len(set(some)))
    values = (np.diff(at), total(((data & 0xC0) != 0x80) & ~_IS_SPACE[data], ends), total(_IS_SYMBOL[data], ends), np.array(lines, np.int64), total(covered[: len(h)], at))
    return dict(zip(RULES, (v.astype(np.int64) for v in values), strict=True))


def _failed(counts: dict) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _trains(counts: dict) -> np.ndarray:
    return ~_failed(counts) & (10 * counts["n_symbols"] <= counts["n_words"])


def _tag(lang: str | None, half: int) -> int:
    """The name of a language's model: null is a language of its own."""
    raw = b"" if lang is None else b"=" + lang.encode()
    return (int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) & ~1) | half


def _runs(blobs: list, kind: list[int]):
    """Packed bytes of the run that ends at each byte, with the kind of its text
    above them, and the text; a few megabytes at a time, long texts in pieces."""
    held, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(p for _, p in held), np.uint8)
        key = np.zeros(len(data) - len(_PAD), np.uint64)
        for k in range(ORDER):
            key <<= np.uint64(8)
            key |= data[k : k + len(key)]
        inside = np.ones(len(key), bool)  # all but the runs that begin in one piece and end in the next
        ends = np.cumsum([len(p) for _, p in held])[:-1]
        for k in range(1, len(_PAD) + 1):
            inside[ends - k] = False
        key = key[inside]
        text = np.repeat(np.array([i for i, _ in held], np.int32), [len(p) - len(_PAD) for _, p in held])
        key |= (np.array(kind, np.uint64) << np.uint64(8 * ORDER))[text]
        return key, text

    for i, blob in enumerate(blobs):
        if not blob:
            continue
        data = _PAD + blob.translate(_TABLE)
        for a in range(0, len(data) - len(_PAD), _PIECE):
            held.append((i, data[a : a + _PIECE + len(_PAD)]))
            size += len(held[-1][1])
            if size >= _PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _kinds(langs: list, halves: list) -> tuple[list[int], np.ndarray]:
    """Number of each text's model among those met, and the models' tags."""
    tags: dict[int, int] = {}
    kind = [tags.setdefault(_tag(lang, half), len(tags)) for lang, half in zip(langs, halves, strict=True)]
    return kind, np.array(list(tags), np.int64)


_KEY = np.uint64((1 << (8 * ORDER)) - 1)


def _count(batches):
    """(tag, key, n): runs of bytes of the texts that train."""
    for batch in batches:
        blobs, langs, halves = blobs_of(batch, "text"), batch.column("lang").to_pylist(), batch.column("half").to_pylist()
        for a, z in chunks(blobs, _PIECE):
            use = [a + k for k in np.flatnonzero(_trains(base_counts(blobs[a:z])))]
            kind, tags = _kinds([langs[k] for k in use], [halves[k] for k in use])
            for key, _ in _runs([blobs[k] for k in use], kind):
                key, n = np.unique(key, return_counts=True)
                columns = tags[(key >> np.uint64(8 * ORDER)).astype(np.int64)], (key & _KEY).astype(np.int64), n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["tag", "key", "n"])


def _half(shift: int) -> Column:
    return F.pmod(F.xxhash64("text") + F.lit(shift), F.lit(2)).cast("int").alias("half")


def _low(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, by model;
    where counts of counts do not allow them 0.5, 1 and 1.5."""
    n = counts.groupBy("tag").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = [F.col("tag")]
    for k in (1, 2, 3):
        d = F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        out.append(F.when((d > 0) & (d < k), d).otherwise(k / 2).alias(f"d{k}"))
    return n.select(*out)


def _stored(batches):
    """Hash and slice bucket of each entry. An entry is of a run (kind 0) or of
    a context that runs of that order have (kind 1)."""
    for batch in batches:
        kind, order, tag, key = (batch.column(c).to_numpy() for c in ("kind", "order", "tag", "key"))
        bits = key.astype(np.uint64)
        h = _hash(tag, order, bits, kind)
        pair = np.where(kind == 0, bits >> np.uint64(8), bits) & np.uint64(0xFFFF)
        bucket = np.where(order > 2, _bucket(tag, pair), -1)  # short ones belong to every slice
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket, pa.int32()), pa.array(h.view(np.int64)), batch.column("value")], names=["kind", "bucket", "h", "value"])


def _hash(tag, order, key, kind) -> np.ndarray:
    packed = key | (np.uint64(8) * kind + order).astype(np.uint64) << np.uint64(8 * ORDER)
    return _mix(packed * _ODD + _mix(np.asarray(tag).view(np.uint64)))


def _bucket(tag: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (_mix(pair * _ODD + _mix(tag.view(np.uint64) + _ODD)) >> np.uint64(52)).astype(np.int32)


def fit(docs: DataFrame) -> DataFrame:
    """The model of rows with text and lang: entries (kind, bucket, h, value)
    sorted by hash, in the shared folder. Null texts train nothing."""
    texts = docs.where("text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), _half(0))
    counted = texts.mapInArrow(tidy(_count), "tag long, key long, n long")
    tables = {ORDER: cut(counted.groupBy("tag", "key").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = cut(tables[k + 1].groupBy("tag", _low(k).alias("key")).agg(F.count("*").alias("n")))
    entries, lower = [], None
    for k in range(1, ORDER + 1):
        known = tables[k].join(_discounts(tables[k]), "tag").withColumn("context", F.shiftright("key", 8))
        weight = F.col("d1") * F.count_if(F.col("n") == 1) + F.col("d2") * F.count_if(F.col("n") == 2) + F.col("d3") * F.count_if(F.col("n") > 2)
        contexts = cut(known.groupBy("tag", "context", "d1", "d2", "d3").agg(F.sum("n").alias("all"), (weight / F.sum("n")).alias("weight")))
        rows = tables[k].withColumn("context", F.shiftright("key", 8)).join(contexts, ["tag", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", _low(k - 1)).join(lower.select("tag", F.col("key").alias("suffix"), F.col("p").alias("below")), ["tag", "suffix"])
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        lower = cut(rows.select("tag", "key", ((F.col("n") - discount) / F.col("all") + F.col("weight") * F.col("below")).alias("p")))
        for kind, table, key, value in ((0, lower, "key", "p"), (1, contexts, "context", "weight")):
            fixed = F.round(F.log2(value) * _ONE).cast("int").alias("value")
            entries.append(table.select(F.lit(kind).cast("long").alias("kind"), F.lit(k).cast("long").alias("order"), "tag", F.col(key).alias("key"), fixed))
    rows = reduce(DataFrame.unionAll, entries).mapInArrow(tidy(_stored), "kind long, bucket int, h long, value int")
    model = cut(rows.repartitionByRange("h").sortWithinPartitions("h"))
    discard(*tables.values())
    return model


def _slices(model: DataFrame, bound: int) -> list[tuple[int, int]]:
    """Ranges of buckets with at most about `bound` entries each; a single one may have more."""
    sizes = dict(model.groupBy("bucket").count().collect())  # a row a bucket
    out, first, held = [], 0, sizes.get(-1, 0)
    for bucket in range(_BUCKETS):
        more = sizes.get(bucket, 0)
        if bucket > first and held + more > bound:
            out.append((first, bucket))
            first, held = bucket, sizes.get(-1, 0)
        held += more
    return [*out, (first, _BUCKETS)]


class _Slice:
    """Sorted hash arrays of the buckets from `low` to below `high`."""

    def __init__(self, model: DataFrame, low: int, high: int):
        self.low, self.high, self.arrays = low, high, []
        table = model.where(F.col("bucket").between(low, high - 1) | (F.col("bucket") < 0)).select("kind", "h", "value").toArrow()
        kind, h, value = (table.column(c).to_numpy() for c in ("kind", "h", "value"))
        for k in (0, 1):
            own = h[kind == k].view(np.uint64)
            order = np.argsort(own)
            self.arrays.append((own[order], value[kind == k][order]))

    def _look(self, kind: int, order: int, tag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = self.arrays[kind]
        if not len(known):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        h = _hash(tag, np.uint64(order), key, np.uint64(kind))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return known[at] == h, value[at].astype(np.int64)

    def score(self, tag: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run, negative; 0 where another slice knows."""
        out = np.zeros(len(key), np.int64)
        bucket = _bucket(tag, (key >> np.uint64(8)) & np.uint64(0xFFFF))
        left = np.flatnonzero((bucket >= self.low) & (bucket < self.high))
        for order in range(ORDER, 0, -1):
            run = key[left] & np.uint64((1 << (8 * order)) - 1)
            hit, value = self._look(0, order, tag[left], run)
            out[left[hit]] += value[hit]
            left, run = left[~hit], run[~hit]
            hit, value = self._look(1, order, tag[left], run >> np.uint64(8))
            out[left[hit]] += value[hit]
        out[left] += _UNSEEN
        return out


def _bits(part: _Slice, blobs: list, langs: list, halves: list) -> np.ndarray:
    """Sum of the bits (negative) of each text that this slice knows."""
    out = np.zeros(len(blobs), np.int64)
    kind, tags = _kinds(langs, halves)
    for key, text in _runs(blobs, kind):
        run, back = np.unique(key, return_inverse=True)
        value = part.score(tags[(run >> np.uint64(8 * ORDER)).astype(np.int64)], run & _KEY)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] += np.add.reduceat(value[back], first)
    return out


def _judged(shared, schema):
    def run(batches):
        for batch in batches:
            blobs, langs, halves = blobs_of(batch, "text"), batch.column("__lang").to_pylist(), batch.column("__half").to_pylist()
            out = {name: [] for name in (*RULES, "__trains", "__bits", "__bytes")}
            for a, z in chunks(blobs, _PIECE):
                counts = base_counts(blobs[a:z])
                counts |= {"__trains": _trains(counts), "__bits": _bits(shared.value, blobs[a:z], langs[a:z], halves[a:z]), "__bytes": np.array([len(b or b"") for b in blobs[a:z]])}
                for name in out:
                    out[name].append(counts[name])
            yield replaced(batch, schema, {name: pa.array(np.concatenate(v) if v else [], schema.field(name).type) for name, v in out.items()})

    return run


def _more_bits(shared):
    def run(batches):
        for batch in batches:
            blobs, langs, halves = blobs_of(batch, "text"), batch.column("__lang").to_pylist(), batch.column("__half").to_pylist()
            for a, z in chunks(blobs, _PIECE):
                bits = _bits(shared.value, blobs[a:z], langs[a:z], halves[a:z])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, z - a) for c in ("__lang", "__h1", "__h2")), pa.array(bits, pa.int64())], names=["__lang", "__h1", "__h2", "more"])

    return run


def _bands(scored: DataFrame, tail: int) -> DataFrame:
    """Lowest and highest thousandths of a bit a byte by language: `tail` of a
    thousand distinct training texts lie below and above."""
    texts = scored.where("__trains").select("__lang", "__h1", "__h2", "__level").distinct().groupBy("__lang", "__level").count()
    by = Window.partitionBy("__lang")
    ranked = texts.withColumn("upto", F.sum("count").over(by.orderBy("__level"))).withColumn("all", F.sum("count").over(by))
    return ranked.groupBy("__lang").agg(
        F.min(F.when(1000 * F.col("upto") > tail * F.col("all"), F.col("__level"))).alias("__low"),
        F.min(F.when(1000 * F.col("upto") >= (1000 - tail) * F.col("all"), F.col("__level"))).alias("__high"),
    )


def judge(docs: DataFrame, tail: int = 2, bound: int = 1 << 23, texts: bool = True) -> DataFrame:
    """Add the base counts, base_failed, bits_per_byte (log2 of the perplexity)
    and kept to every row: kept is false if the base rules fail or the
    perplexity lies outside the band of the row's language.

    Null and empty texts have no words and fail the base rules; their bits are
    null. A null lang is a language of its own. A language none of whose texts
    trains has no band and only the base rules judge it; with few texts the
    band spans all of them. Repeated rows are judged alike and count once in
    the bands, and train as often as they come. Columns of the added names are
    replaced, all others pass through; `texts=False` drops text and lang.
    """
    spark = docs.sparkSession
    model = fit(docs)
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    marks = {"__lang": F.col("lang").cast("string"), "__half": _half(1), "__h1": F.xxhash64("text"), "__h2": F.xxhash64("text", F.lit(7))}
    ready = docs.withColumns(marks)
    scored, more = None, []
    for low, high in _slices(model, bound):
        shared = spark.sparkContext.broadcast(_Slice(model, low, high))
        if scored is None:
            scored = with_columns(ready, "".join(f"{name} long, " for name in RULES) + "__trains boolean, __bits long, __bytes long", lambda schema, s=shared: _judged(s, schema))
            scored = scored.withColumn("__lang", lang).drop("__half", *(() if texts else ("text", "lang")))
            scored = cut(scored)
        else:
            rows = ready.where("text IS NOT NULL").select("text", "__lang", "__half", "__h1", "__h2").mapInArrow(tidy(_more_bits(shared)), "__lang string, __h1 long, __h2 long, more long")
            rows = rows.withColumn("__lang", F.coalesce(F.concat(F.lit("="), "__lang"), F.lit("")))
            more.append(cut(rows.groupBy("__lang", "__h1", "__h2").agg(F.first("more").alias("more"))))
        shared.unpersist()
    if more:
        sums = reduce(DataFrame.unionAll, more).groupBy("__lang", "__h1", "__h2").agg(F.sum("more").alias("more"))
        scored = scored.join(sums, ["__lang", "__h1", "__h2"], "left").withColumn("__bits", F.col("__bits") + F.coalesce("more", F.lit(0))).drop("more")
        scored = cut(scored)
    thousandths = F.expr(f"(-__bits * 1000) div (nullif(__bytes, 0) * {_ONE})")
    scored = scored.withColumn("__level", thousandths)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("__level").between(F.col("__low"), F.col("__high")), F.lit(True))
    out = scored.join(_bands(scored, tail), "__lang", "left").withColumns({"base_failed": failed, "kept": ~failed & inside, "bits_per_byte": F.col("__level") / 1000})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
