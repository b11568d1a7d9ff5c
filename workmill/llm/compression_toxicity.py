"""Toxicity by compression distance, with zstandard dictionaries.

Dictionaries are trained on ordinary text, on the windows of toxic documents, and
on their marked words. A text is cut into windows of words. A window's margin is
the length it compresses to with the ordinary dictionary alone, less that with a
toxic one before it: what toxic text explains and ordinary text does not. All are
used as plain content, so ordinary matches cost the same either way and margins
of clean windows stay near zero. The document's score is a logistic function of
its largest margins by both toxic dictionaries, calibrated on labelled documents
that the dictionaries have not seen.

Labels belong to documents, of which most words are ordinary and drown the others
in the dictionary of windows. So the second one is trained on words of toxic
documents with a run of characters that is far more usual in toxic documents than
in ordinary ones; words too rare for that are left to the first.

The model is fitted on a bounded sample; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import chunks, distinct_sample, rows_at_most, with_columns
from workmill.session import cut

_WORDS = 16  # of a window
_BREAK = re.compile(r"[^\W\d_]+")
_GRAM = 5  # bytes of a run
_ODD = 3.0  # log of how many times more usual it is in toxic documents
_TOP = 3  # margins that count
_LARGE = 4  # bytes saved by a whole word


def windows(text: str | None) -> list[bytes]:
    """Runs of lower-cased words over the whole text."""
    own = _BREAK.findall((text or "").lower())
    return [(" " + " ".join(own[k : k + _WORDS]) + " ").encode() for k in range(0, len(own), _WORDS)]


def _grams(word: bytes) -> set[bytes]:
    marked = b" " + word + b" "
    return {marked[k : k + _GRAM] for k in range(max(1, len(marked) - _GRAM + 1))}


class Margins:
    """Compression lengths with and without each toxic dictionary."""

    def __init__(self, toxic: list[bytes], ordinary: bytes):
        make = zstandard.ZstdCompressionParameters.from_level(6, source_size=64, dict_size=max(map(len, toxic)) + len(ordinary), write_content_size=False, write_dict_id=False, write_checksum=False, min_match=4)
        self.lengths = []
        for data in (ordinary, *(x + ordinary for x in toxic)):
            book = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(compression_params=make)
            self.lengths.append(zstandard.ZstdCompressor(dict_data=book, compression_params=make).compress)

    def of(self, window: bytes) -> tuple[int, ...]:
        ordinary, *toxic = (len(compress(window)) for compress in self.lengths)
        return tuple(ordinary - n for n in toxic)

    def features(self, own: list[bytes]) -> list[float]:
        """By dictionary the largest margins and how many are large; how many windows."""
        margins = list(map(self.of, set(own)))
        out = []
        for k in range(len(self.lengths) - 1):
            found = sorted((m[k] for m in margins), reverse=True)
            out += [*map(float, found[:_TOP] + [0] * (_TOP - len(found))), math.log1p(sum(m >= _LARGE for m in found))]
        return [*out, math.log1p(len(margins))]


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary; the plain text itself where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes() if len(samples) > 50 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic fit by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (each * (p - y)) + 1e-2 * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def _odd_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words of toxic texts with a run of bytes that marks them."""
    texts = [[{x for w in own for x in w.split()} for own in side] for side in (ordinary, toxic)]
    spread = [Counter(g for own in side for g in set().union(*map(_grams, own))) for side in texts]

    def odd(gram: bytes) -> bool:
        rates = [math.log((spread[y][gram] + 0.3) / len(texts[y])) for y in (0, 1)]
        return spread[1][gram] >= max(6, len(toxic) // 300) and rates[1] - rates[0] > _ODD

    marks = {g for g in spread[1] if odd(g)}
    return [b" " + x + b" " for own in texts[1] for x in sorted(own) if not marks.isdisjoint(_grams(x))]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[dict, DataFrame]:
    """Distinct texts of each label, and about `sample` of them by label.

    Only ids and hashes of the texts meet the labels; the texts of the hashes
    drawn, which the sample bounds, are then picked out of a scan.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("_h", F.xxhash64("text", F.lit(11)))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    known = cut(texts.select("doc_id", "_h").join(marks, "doc_id").select("toxic", "_h").distinct())
    sizes = {r[0]: r[1] for r in rows_at_most(known.groupBy("toxic").count(), 2)}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, min(1.0, sample / n)).otherwise(share)
    drawn = known.where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    found = texts.join(F.broadcast(drawn), "_h").groupBy("toxic", "_h").agg(F.first("text").alias("text"))
    return sizes, found.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = 4000, toxic_size: int = 10_000, ordinary_size: int = 50_000) -> dict:
    """A model from rows with text and toxic (0 or 1), or with doc_id and text
    and `labels` with doc_id and toxic.

    About `sample` distinct texts of each class are drawn by a hash of the text
    and fitted on the driver: this is the documented bound. Half of them train
    the dictionaries, the others calibrate; classes weigh as distinct texts do.
    Null ids, texts and labels teach nothing, rows that repeat count once, and
    without labelled texts the model is constant.
    """
    if labels is None:
        known = docs.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("text IS NOT NULL AND toxic IN (0, 1)")
        sizes, drawn = distinct_sample(known, "toxic", sample, seed=11, bound=2)
    else:
        sizes, drawn = labelled_sample(docs, labels, sample)
    if len(sizes) < 2:
        return {"constant": float(max(sizes, default=0))}
    share = {y: min(1.0, sample / n) for y, n in sizes.items()}
    most = 2 * (sample + int(10 * math.sqrt(sample)) + 10)  # ten standard deviations of the draw
    rows = sorted(rows_at_most(drawn.mapInArrow(_sampled, "toxic int, half int, windows array<binary>"), most))
    part = {(y, h): [list(map(bytes, r.windows)) for r in rows if r.toxic == y and r.half == h] for y in (0, 1) for h in (0, 1)}
    if not all(part.values()):
        return {"constant": float(sizes[1] > sizes[0])}
    toxic = [_train([w for own in part[1, 0] for w in own], toxic_size), _train(_odd_words(part[1, 0], part[0, 0]) * 3, toxic_size)]
    ordinary = _train([w for own in part[0, 0] for w in own], ordinary_size)
    margins = Margins(toxic, ordinary)
    x = np.array([margins.features(own) for y in (0, 1) for own in part[y, 1]])
    y = np.array([float(y) for y in (0, 1) for _ in part[y, 1]])
    return {"toxic": toxic, "ordinary": ordinary, "weights": _logistic(x, y, np.where(y == 1, share[0] / share[1], 1.0))}


def _sampled(batches):
    import zlib

    for batch in batches:
        texts = batch.column("text").to_pylist()
        half = [zlib.crc32(t.encode()) >> 3 & 1 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(half, pa.int32()), pa.array(map(windows, texts), pa.list_(pa.binary()))], names=["toxic", "half", "windows"])


def _score(shared, schema):
    def run(batches):
        model = shared.value
        margins = Margins(model["toxic"], model["ordinary"]) if "weights" in model else None
        for batch in batches:
            texts, score = batch.column("text").cast(pa.string()).to_pylist(), []
            for i, j in chunks(texts):
                if margins is None:
                    score += [model["constant"]] * (j - i)
                else:
                    x = np.array([margins.features(windows(t)) + [1.0] for t in texts[i:j]])
                    score += (1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30)))).tolist()
            new = {"score": pa.array(score, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in score], pa.int32())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return run


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """Add score (0 to 1) and predicted (score >= 0.5) to every row.

    Null and empty texts have no windows: all margins are 0. A model of one
    class, or of none, gives that class (or 0) to all. Other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size
    return with_columns(docs, "score double, predicted int", lambda schema: _score(shared, schema))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 is 0; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
