"""Substring dedup: windows of words that an earlier document has already.

Method: a count-min prefilter, then exact grouping. Every window is counted
under its anchor, the smallest of the hashes of its short word runs; equal
windows have equal anchors, so an anchor's count is never below the count of a
window. The sketch has two rows of 2^40 cells and is kept sparse: the partial
aggregate of a partition is that partition's sketch, and the shuffle adds them
up. As only occupied cells are kept, its size follows the input and no cell
fills up as data grows. The second row counts what the first row let pass. A
second pass over the texts takes out only windows whose anchor was met at least
twice, written once, and groups those exactly, by 128 bits of hash. The grouping
goes over all of them in `passes` shares of the hashes, which bounds the shuffle
files on disk. No window is lost.

Memory: a task holds about two megabytes of text at a time (or one longer
text). Hot windows: minima combine before the shuffle, and the join back has
one row per window on its small side, so that AQE can split the large one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import blobs_of, chunks, discard, lists, release, replaced, rolling, tidy, with_columns, within, word_hashes, words
from workmill.session import cut

_SHORT = 6  # words of an anchor
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CELL_BITS = 40


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of the window at each place."""
    short = min(_SHORT, width)
    low, have, need = rolling(h, short, _FACTORS[0]), 1, width - short + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def _anchor_lists(width):
    def run(batches):
        for batch in batches:
            texts, ids = blobs_of(batch, "text"), batch.column("doc_id")
            for i, j in chunks(texts):
                h, at = word_hashes(texts[i:j])
                place, text = within(at, width)
                anchor = _anchors(h, width)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                column = lists(anchor[new], np.bincount(text[new], minlength=j - i), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), column], names=["doc_id", "anchors"])

    return run


def _windows(width):
    def run(batches):
        for batch in batches:
            texts, ids, flagged = blobs_of(batch, "text"), batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("anchors")
            for i, j in chunks(texts):
                h, at = word_hashes(texts[i:j])
                place, text = within(at, width)
                if not len(place):
                    continue
                anchor = _anchors(h, width)[place].view(np.int64)
                begin = np.searchsorted(text, np.arange(j - i + 1))
                hit = np.zeros(len(place), bool)
                for k in range(j - i):
                    part = slice(begin[k], begin[k + 1])
                    hit[part] = np.isin(anchor[part], flagged[i + k].values.to_numpy(zero_copy_only=False))
                place, text = place[hit], text[hit]
                values = [rolling(h, width, f)[place].view(np.int64) for f in _FACTORS[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*values, ids[i:j][text], place - at[text])], names=["h1", "h2", "doc_id", "pos"])

    return run


def _remove(width, schema):
    def run(batches):
        for batch in batches:
            texts, marks = blobs_of(batch, "text"), batch.column("__marks").to_pylist()
            out = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept")}
            for text, mark in zip(texts, marks, strict=True):
                own = words(text)
                if mark and len(own) >= width:
                    own, gone = _uncovered(own, np.array(mark, np.int64), width)
                else:
                    gone = 0
                joined = b" ".join(own)
                out["n_words"].append(len(own) + gone)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept"].append(joined if gone else text)
            yield replaced(batch, schema, {f.name: pa.array(out[f.name], pa.binary() if f.type == pa.string() and f.name == "kept" else f.type).cast(f.type) for f in schema if f.name in out})

    return run


def _uncovered(own: list[bytes], mark: np.ndarray, width: int) -> tuple[list[bytes], int]:
    """Words outside the marked windows. A mark is a place and 32 bits of the
    window's hash; marks of another text under the same id do not fit."""
    h, _ = word_hashes([b" ".join(own)])
    place = mark >> 32
    mark, place = mark[place <= len(own) - width], place[place <= len(own) - width]
    place = place[(rolling(h, width, _FACTORS[1])[place] & np.uint64(0xFFFFFFFF)).astype(np.int64) == mark & 0xFFFFFFFF]
    edge = np.zeros(len(own) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + width, -1)
    stay = np.cumsum(edge)[:-1] == 0
    return [w for w, s in zip(own, stay, strict=True) if s], int((~stay).sum())


def _repeated(rows: DataFrame) -> DataFrame:
    """Anchors whose cell, in each row of the sketch, was met at least twice.

    The sketch is written before the join, which then has a shuffle of its own
    on both sides: only such joins are split where a cell is hot.
    """
    for cell in (F.shiftrightunsigned("anchor", 64 - _CELL_BITS), F.col("anchor").bitwiseAND(F.lit((1 << _CELL_BITS) - 1))):
        sketch = cut(rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where("n >= 2").select("cell"))
        release(rows.sparkSession)
        rows = cut(rows.join(sketch.hint("merge"), cell == F.col("cell"), "left_semi"))
        discard(sketch)
    return rows


def _marks(windows: DataFrame, passes: int) -> DataFrame:
    """(doc_id, __marks): the windows of each document that an earlier one has.

    One pass groups the windows of one share of the hashes, so that the shuffles
    of one share at a time lie on disk.
    """
    spark, found = windows.sparkSession, []
    for k in range(passes):
        part = windows.where(F.pmod("h1", F.lit(passes)) == k)
        first = cut(part.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
        release(spark)
        mark = F.shiftleft("pos", 32).bitwiseOR(F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF)))
        found.append(cut(part.join(first.hint("merge"), ["h1", "h2"]).where("first < doc_id").select("doc_id", mark.alias("mark"))))
        release(spark)
        discard(first)
    marks = cut(reduce(DataFrame.unionAll, found).groupBy("doc_id").agg(F.collect_list("mark").alias("__marks")))
    discard(*found)
    return marks


def remove_repeats(docs: DataFrame, width: int = 13, texts: bool = True, passes: int = 4) -> DataFrame:
    """Take out words that lie in a window an earlier document has too.

    Words stand between ASCII white space and are compared unchanged. A window
    is `width` words; it counts against a document if it also starts in one
    with a smaller doc_id. All windows are judged on the input.

    Adds n_words, n_removed, kept_sha256 (of the kept words joined by one
    blank) and, with `texts`, kept: those words, or the text as it is if nothing
    went. Columns of these names are replaced; other columns stay.

    Null or empty text: no words. A null doc_id is neither earlier nor later:
    its row stays whole and takes nothing from others. Rows that repeat an id
    never count against each other. No rows: no rows.
    """
    spark = docs.sparkSession
    base = docs.drop("n_words", "n_removed", "kept_sha256", "kept", "__marks")
    narrow = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = cut(narrow.mapInArrow(tidy(_anchor_lists(width)), "doc_id long, anchors array<long>").where(F.size("anchors") > 0))
    rows = _repeated(anchors.select("doc_id", F.explode("anchors").alias("anchor")))
    release(spark)
    discard(anchors)
    flagged = rows.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = cut(narrow.join(flagged.hint("shuffle_hash"), "doc_id").mapInArrow(tidy(_windows(width)), "h1 long, h2 long, doc_id long, pos long"))
    release(spark)
    discard(rows)
    marks = _marks(windows, passes)
    release(spark)
    discard(windows)
    added = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    both = base.join(marks.withColumnRenamed("doc_id", "__id").hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    return with_columns(both, added, lambda schema: _remove(width, schema), ["__marks"])
