"""Ranked lexical search without an index of the documents.

An Aho-Corasick automaton of all items' terms, each guarded by a blank on both
sides, runs over every text in which all but letters and digits is blank; its
outputs are the occurrences of the terms, and each term lists the items that
have it. One scan counts documents, terms and the documents of each term, a
second one scores: a task adds up the scores of a few documents at a time and
holds the best `top` of each item only.

Items are taken in blocks of about `block` (item, term) pairs, so what is
broadcast is bounded by that or by the one item that is larger. Nothing of the
documents is shuffled but the few best of each task and item.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmill.llm.common import ALNUM, blobs_of, chunks, tidy, words
from workmill.session import cut

_BUCKETS = 64  # parts an equal share of the items is cut into, to fill blocks evenly
_DOCS, _TERMS = -1, -2  # rows of the statistics that are no term
_BITE = 1 << 20  # products held at a time
_CELLS = 1 << 21  # scores held at a time
_SPREAD = 256


class _Terms:
    """The terms of a block of items; finds them in texts."""

    def __init__(self, items: list, pairs: list[tuple[int, bytes, int]]):
        self.items = items
        pairs = sorted(pairs, key=itemgetter(1, 0))
        self.terms = sorted({t for _, t, _ in pairs})
        number = {t: k for k, t in enumerate(self.terms)}
        self.item = np.array([p[0] for p in pairs], np.int64)
        self.uses = np.array([p[2] for p in pairs], np.int64)
        self.at = np.searchsorted(np.array([number[p[1]] for p in pairs], np.int64), np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def counts(self, blob: bytes) -> Counter:
        """How often each term is in the text, by the term's number."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                self._automaton.add_word(f" {term.decode('latin-1')} ", k)
            self._automaton.make_automaton()
        guarded = f" {blob.translate(ALNUM).decode('latin-1')} "
        return Counter(map(itemgetter(1), self._automaton.iter(guarded)))


def _item_terms(batches):
    for batch in batches:
        out = {"item_id": [], "term": [], "uses": []}
        for item, blob in zip(batch.column("item_id").to_pylist(), blobs_of(batch, "text"), strict=True):
            for term, uses in Counter(words(blob, ALNUM)).items():
                out["item_id"].append(item)
                out["term"].append(term)
                out["uses"].append(uses)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"item_id": pa.int64(), "term": pa.binary(), "uses": pa.int64()}))


def _blocks(items: DataFrame, block: int) -> list[_Terms]:
    """The items' terms, cut where `block` pairs are reached."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    pairs = rows.mapInArrow(tidy(_item_terms), "item_id long, term binary, uses long")
    pairs = cut(pairs.groupBy("item_id", "term").agg(F.sum("uses").alias("uses")))
    parts = max(1, -(-pairs.count() * _BUCKETS // block))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    sizes = dict(pairs.groupBy("part").count().collect())
    ranges, first, held = [], 0, 0
    for part in range(parts):
        if held and held + sizes.get(part, 0) > block:
            ranges.append((first, part))
            first, held = part, 0
        held += sizes.get(part, 0)
    ranges.append((first, parts))
    out = []
    for low, high in ranges:
        found = pairs.where(F.col("part").between(low, high - 1)).drop("part").collect()
        ids = sorted({r.item_id for r in found}, key=lambda x: (x is None, x))
        place = {x: k for k, x in enumerate(ids)}
        out.append(_Terms(ids, [(place[r.item_id], bytes(r.term), r.uses) for r in found]))
    return out


def _statistics(shared):
    """(term, documents) of a task, and its numbers of documents and terms."""

    def run(batches):
        block = shared.value
        found, docs, length = np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for blob in blobs_of(batch, "text"):
                n = len(words(blob, ALNUM))
                if n:
                    docs += 1
                    length += n
                    found[list(block.counts(blob))] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [_DOCS, _TERMS])), pa.array(np.append(found[some], [docs, length]))], names=["term", "n"])

    return run


def _scored(block: _Terms, blobs: list, docs: int, length: int):
    """(first text, scores by text and item) of a few texts at a time."""
    ends, terms, tf, m = [0], [], [], []
    for blob in blobs:
        seen = block.counts(blob) if blob else {}
        terms += seen.keys()
        tf += seen.values()
        ends.append(len(terms))
        m.append(100 - 25 + (25 * len(words(blob, ALNUM)) * docs) // length if seen else 1)
    terms, tf, ends = np.array(terms, np.int64), np.array(tf, np.int64), np.array(ends)
    text = np.repeat(np.arange(len(blobs)), np.diff(ends))
    value = block.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.array(m, np.int64)[text]))
    share = block.at[terms + 1] - block.at[terms]
    grown = np.concatenate([[0], np.cumsum(share)])[ends]
    most = max(1, _CELLS // len(block.items))
    i = 0
    while i < len(blobs):
        j = min(i + most, max(i + 1, int(np.searchsorted(grown, grown[i] + _BITE, "right")) - 1), len(blobs))
        part = slice(ends[i], ends[j])
        times = share[part]
        row = np.repeat(np.arange(ends[i], ends[j]), times)
        post = np.repeat(block.at[terms[part]] - (np.cumsum(times) - times), times) + np.arange(len(row))
        scores = np.zeros((j - i, len(block.items)), np.int64)
        np.add.at(scores, (text[row] - i, block.item[post]), value[row] * block.uses[post])
        yield i, scores
        i = j


def _best(shared, docs, length, top):
    """The best `top` rows of each item among a task's documents."""

    def run(batches):
        block = shared.value
        # Columns: item, score, document without an id, document.
        held = np.zeros((4, 0), np.int64)
        least = np.ones(len(block.items), np.int64)
        for batch in batches:
            column = batch.column("doc_id").cast(pa.int64())
            lost, ids = column.is_null().to_numpy(zero_copy_only=False).astype(np.int64), column.fill_null(0).to_numpy(zero_copy_only=False)
            texts = blobs_of(batch, "text")
            for a, b in chunks(texts, 1 << 18):
                for i, scores in _scored(block, texts[a:b], docs, length):
                    doc, item = np.nonzero(scores >= least)
                    if not len(doc):
                        continue
                    held = np.concatenate([held, [item, scores[doc, item], lost[a + i + doc], ids[a + i + doc]]], axis=1)
                    held = held[:, np.lexsort((held[3], held[2], -held[1], held[0]))]
                    place = np.arange(held.shape[1]) - np.searchsorted(held[0], held[0])
                    held, place = held[:, place < top], place[place < top]
                    full = place == top - 1
                    least[held[0, full]] = held[1, full]
        item = pa.array([block.items[k] for k in held[0]], pa.int64())
        yield pa.RecordBatch.from_arrays([item, pa.array(held[3], pa.int64(), mask=held[2] == 1), pa.array(held[1])], names=["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, top: int = 20, block: int = 1 << 18) -> DataFrame:
    """The `top` documents with the highest score above 0 of each item: item_id,
    rank, doc_id, score.

    A null or empty text has no terms and is no document; an item without terms
    has no rows. Rows that repeat an item's id and text count once, and an item
    with several texts has the terms of all. Every row of `docs` is a document;
    equal scores go by doc_id, rows without an id last. Texts are scanned whole.
    Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    found = []
    for terms in _blocks(items, block):
        if not terms.items:
            continue
        shared = spark.sparkContext.broadcast(terms)
        counted = texts.select("text").mapInArrow(tidy(_statistics(shared)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        total = {r.term: r.n for r in counted.collect()}  # a row a term of the block, and two
        docs_n, length = total.pop(_DOCS, 0), total.pop(_TERMS, 0)
        shared.unpersist()
        for k in range(len(terms.terms)):
            terms.weight[k] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * total.get(k, 0) + 1)))
        shared = spark.sparkContext.broadcast(terms)
        best = texts.mapInArrow(tidy(_best(shared, docs_n, length, top)), "item_id long, doc_id long, score long")
        found.append(best.withColumn("_part", F.spark_partition_id() % _SPREAD))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = reduce(DataFrame.unionAll, found)
    # Two steps, so that no task gets an item's rows of all tasks.
    for by in (["item_id", "_part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
