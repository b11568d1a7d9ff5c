"""Language identification by known words, backing off to character n-grams.

A known word scores its per-language log frequency. For an unseen word the
longest character n-grams (word ends marked) of which any is known score by
their mean, down to single characters. A text's score is the mean over its
words; the share of the best language in a softmax over at most `evidence` words
is the confidence.

The model is fitted on a bounded sample of labelled texts; its size is bounded
by the number of words and n-grams kept. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import chunks, distinct_sample, tidy, with_columns
from workmill.session import cut

_WORD = re.compile(r"[^\W\d_]+")
_LONGEST = 4
_CACHE = 200_000
LANGUAGES = 500  # most languages a model may have


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _count(batches):
    """(lang, n, item, times): words as n = 0, n-grams of words by length."""
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        rows = Counter()
        for lang, words in by_lang.items():
            for word, times in words.items():
                rows[lang, 0, word] += times
                for n in range(1, _LONGEST + 1):
                    for gram in _grams(word, n):
                        rows[lang, n, gram] += times
        keys = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64())], names=["lang", "n", "item", "times"])


def fit(docs: DataFrame, sample: int = 400, kept: int = 40_000) -> dict:
    """A model from rows with text and lang: about `sample` distinct texts a
    language, drawn by a hash of the text, and the `kept` most frequent words and as many
    n-grams of each length."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes, drawn = distinct_sample(known, "lang", sample, seed=7, bound=LANGUAGES)
    if not sizes:
        return {"langs": [], "tables": []}
    counts = drawn.mapInArrow(tidy(_count), "lang string, n int, item string, times long").groupBy("n", "item", "lang").agg(F.sum("times").alias("times"))
    items = counts.groupBy("n", "item").agg(F.sum("times").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by")).where("all > 1")
    items = cut(items)
    langs = sorted(sizes)
    tables = []
    for n in range(_LONGEST + 1):
        rows = items.where(F.col("n") == n).orderBy(F.desc("all"), "item").limit(kept).select("item", "by").collect()
        times = np.array([[by.get(lang, 0) for lang in langs] for _, by in rows], np.float64).reshape(len(rows), len(langs))
        logs = np.log((times + 0.5) / (times.sum(axis=0) + 0.5 * len(rows) + 1))
        tables.append((dict(zip((r[0] for r in rows), range(len(rows)), strict=True)), logs.astype(np.float32)))
    return {"langs": langs, "tables": tables}


class _Scorer:
    """Scores of words, kept in a cache of bounded size."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)), np.float32)

    def _score(self, word: str) -> np.ndarray:
        known, logs = self.tables[0]
        if word in known:
            return logs[known[word]]
        for n in range(_LONGEST, 0, -1):
            known, logs = self.tables[n]
            if found := [known[g] for g in _grams(word, n) if g in known]:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def places(self, words: list[str]) -> list[int]:
        if len(self.place) > _CACHE:
            self.clear()
        for word in set(words).difference(self.place):
            k = len(self.place)
            if k == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[k] = self._score(word)
            self.place[word] = k
        return list(map(self.place.__getitem__, words))

    def judge(self, text: str | None, evidence: int) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        places = self.places(words)  # may replace the score table
        mean = self.scores[places].mean(axis=0, dtype=np.float64)
        power = np.exp((mean - mean.max()) * min(len(words), evidence))
        best = int(power.argmax())
        return self.langs[best], float(power[best] / power.sum())


def _predict(model, evidence, schema):
    def run(batches):
        scorer = model.value
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            found = [scorer.judge(t, evidence) for i, j in chunks(texts) for t in texts[i:j]]
            new = {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return run


def identify(docs: DataFrame, model: dict, evidence: int = 30) -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row; other columns stay.

    `und` and 0 for a null text, a text without a letter, or an empty model.
    Of languages that score alike, the first by name. Long texts are read whole.
    """
    # Bounded by the model's parameters. A worker's cache lives in the broadcast and goes with it.
    shared = docs.sparkSession.sparkContext.broadcast(_Scorer(model))
    return with_columns(docs, "lang_pred string, score double", lambda schema: _predict(shared, evidence, schema))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 4 is 2; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))
