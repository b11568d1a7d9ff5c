"""Maximal periodic runs of words, by string synchronising sets.

Words are positions 0, 1, ... of a text; a run is a stretch of smallest period p
and length of at least 2p (and `least`) that cannot grow. Periods below 12 are
found directly, as regions where a text equals itself moved by p words. For a
scale t = 4, 8, 16, ... the periods from 3t up to 6t come from a synchronising
set: the places whose window of t words, or the window t words on, has the
least fingerprint of the t + 1 windows between them. Windows of period at most
t/3 take no part. Whether a place belongs to the set depends on its next 2t
words only, so a run of period p >= 3t holds two places p apart with equal 2t
words, or begins inside a highly periodic region. Equal contexts less than 6t
apart propose periods; as none has a period of t/3 or less, a place has at most
18 such partners. Highly periodic regions, found at smaller scales, propose the
periods that the set omits: the distance of their ends, and, where two of equal
period touch out of phase, all distances in phase across the seam.

Every proposal is grown to both sides by the fingerprints of 1, 2, 4, ... words,
and of equal stretches the smallest period counts. Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from workmill.llm.common import _mix, blobs_of, chunks, replaced, with_columns, words

_DIRECT = 12  # periods below this are compared directly
_FIRST = 4  # the first scale; three times it is _DIRECT
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _levels(x: np.ndarray, starts: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of the 1, 2, 4, ... words from each place on.

    Texts come longest first; each level ends with the last text that is as long.
    """
    out, size = [x], 1
    while len(count) and 2 * size <= count[0]:
        k = int(np.searchsorted(-count, -2 * size, "right"))
        end = int(starts[k - 1] + count[k - 1])
        have = out[-1]
        level = _mix(np.arange(end, dtype=np.uint64) * _ODD + np.uint64(size))  # unlike any other where too little is left
        full = min(end, len(have) - size)
        level[:full] = _mix((have[:full] ^ (have[:full] >> np.uint64(31))) * _ODD + have[size : size + full])
        out.append(level)
        size *= 2
    return out


def _grow(levels: list[np.ndarray], i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around place i that has period p: where it begins and ends."""
    i, j = i.copy(), i + p
    end = j.copy()
    at = i.copy()
    for s in range(len(levels) - 1, -1, -1):
        level, size = levels[s], 1 << s
        ok = np.flatnonzero(end < len(level))
        ok = ok[level[at[ok]] == level[end[ok]]]
        at[ok] += size
        end[ok] += size
    for s in range(len(levels) - 1, -1, -1):
        level, size = levels[s], 1 << s
        ok = np.flatnonzero((i >= size) & (j - size < len(level)))
        ok = ok[level[i[ok] - size] == level[j[ok] - size]]
        i[ok] -= size
        j[ok] -= size
    return i, end


def _least_periods(b, e, p):
    """Of equal stretches the one of the smallest period, in order of begin and end."""
    order = np.lexsort((p, e, b))
    b, e, p = b[order], e[order], p[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (e[1:] != e[:-1])
    return b[new], e[new], p[new]


def _direct(x: np.ndarray, least: int):
    """Runs of periods below _DIRECT; of periods 1 and 2 also those short ones
    that make the windows of the first scales highly periodic."""
    found = []
    for p in range(1, min(_DIRECT, len(x))):
        flag = np.zeros(len(x) - p + 2, np.int8)
        flag[1:-1] = x[:-p] == x[p:]
        edge = np.diff(flag)
        b, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        ok = e - b >= max(2 * p, {1: 4, 2: 8}.get(p, least))
        found.append((b[ok], e[ok], np.full(ok.sum(), p)))
    return _least_periods(*(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)))


def _contexts(level: np.ndarray, context: np.ndarray, t: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """Proposals (place, period) of the synchronising set of scale t."""
    b, e, p = runs
    value = level.copy()
    some = (p <= t // 3) & (e - b >= t) & (b < len(value))
    mark = np.zeros(len(value) + 1, np.int32)
    np.add.at(mark, b[some], 1)
    np.add.at(mark, np.minimum(e[some] - t + 1, len(value)), -1)
    value[np.cumsum(mark[:-1]) > 0] = _TOP
    low, have = value, 1
    while have < t + 1:
        step = min(have, t + 1 - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = len(low)
    place = np.flatnonzero(((low == value[:n]) | (low == value[t : t + n])) & (low != _TOP))
    order = np.argsort(context[place], kind="stable")
    place = place[order]
    kind = context[place]
    at, out = np.arange(len(place)), []
    lag = 1
    while len(at):
        at = at[at + lag < len(place)]
        far = place[at + lag] - place[at]
        near = (kind[at + lag] == kind[at]) & (far < 6 * t)
        at, far = at[near], far[near]
        out.append((place[at[far >= 3 * t]], far[far >= 3 * t]))
        lag += 1
    return _joined(out)


def _joined(pairs) -> tuple[np.ndarray, np.ndarray]:
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + [a for a, _ in pairs]), np.concatenate(none + [b for _, b in pairs])


def _regions(x: np.ndarray, t: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of highly periodic regions: runs of 3t - 1 words and more of period t/3 or less."""
    b, e, q = runs
    some = (q <= t // 3) & (e - b >= 3 * t - 1)
    order = np.lexsort((b[some], q[some]))  # runs of one period overlap by less than it: by end as well
    b, e, q = b[some][order], e[some][order], q[some][order]
    out = []
    at, lag = np.arange(len(b)), 1
    while len(at):
        at = at[at + lag < len(b)]
        far = e[at + lag] - e[at]
        near = (q[at + lag] == q[at]) & (far < 6 * t)
        at, far = at[near], far[near]
        out.append((e[at[far >= 3 * t]] - 1, far[far >= 3 * t]))
        lag += 1
    for k in np.flatnonzero((q[1:] == q[:-1]) & (b[1:] <= e[:-1])):
        seam, period = b[k + 1], q[k]
        root = x[seam : seam + period]
        for shift in range(period, 2 * period):
            if np.array_equal(x[seam - shift : seam - shift + period], root):
                p = np.arange(shift, min(6 * t, e[k] - b[k] + 1, e[k + 1] - b[k + 1] + 1), period)
                p = p[p >= 3 * t]
                out.append((np.maximum(seam - p, b[k]), p))
                break
    return _joined(out)


def runs_of(texts: list[list[bytes]], least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of some texts: text, first word, length, period; by text, first word, period."""
    count = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-count, kind="stable")
    count = count[order]
    # One place that equals nothing before each text and after the last.
    starts = np.concatenate([[0], np.cumsum(count + 1)[:-1]]).astype(np.int64) + 1 if len(count) else count
    total = int(count.sum()) + len(count) + 1
    x = _mix(np.arange(total, dtype=np.uint64) * _ODD + np.uint64(0xD1B54A32D192ED03))
    flat = [w for k in order for w in texts[k]]
    if flat:
        inside = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(len(flat))
        x[inside] = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    levels = _levels(x, starts, count)
    runs = _direct(x, least)
    t, s = _FIRST, _FIRST.bit_length() - 1
    while len(count) and 6 * t <= count[0]:
        k = int(np.searchsorted(-count, -6 * t, "right"))
        end = int(starts[k - 1] + count[k - 1])
        i, p = _joined([_contexts(levels[s][:end], levels[s + 1], t, runs), _regions(x, t, runs)])
        if len(i):
            i, p = np.divmod(np.unique(i * (6 * t) + p), 6 * t)
            b, e = _grow(levels, i, p)
            ok = e - b >= np.maximum(2 * p, least)
            runs = _least_periods(*(np.concatenate([old, new[ok]]) for old, new in zip(runs, (b, e, p), strict=True)))
        t, s = 2 * t, s + 1
    b, e, p = (r[runs[1] - runs[0] >= np.maximum(2 * runs[2], least)] for r in runs)
    k = np.searchsorted(starts, b, "right") - 1
    text, first = order[k] if len(k) else k, b - starts[k] if len(k) else b
    by = np.lexsort((p, first, text))
    return text[by], first[by], (e - b)[by], p[by]


def _find(schema, least):
    names = {"n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"} & set(schema.names)

    def run(batches):
        for batch in batches:
            blobs = blobs_of(batch, "text")
            out = {name: [] for name in names}
            for a, z in chunks(blobs):
                texts = [words(blob) for blob in blobs[a:z]]
                text, first, length, period = runs_of(texts, least)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                for k, own in enumerate(texts):
                    part = slice(cuts[k], cuts[k + 1])
                    rows = list(zip(first[part].tolist(), length[part].tolist(), period[part].tolist(), strict=True))
                    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    kept = own
                    if rows:
                        edge = np.zeros(len(own) + 1, np.int32)
                        np.add.at(edge, first[part] + period[part], 1)
                        np.add.at(edge, first[part] + length[part], -1)
                        kept = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    joined = b" ".join(kept)
                    row = {
                        "n_words": len(own),
                        "n_runs": len(rows),
                        "start": best and best[0],
                        "length": best and best[1],
                        "period": best and best[2],
                        "exponent_milli": best and 1000 * best[1] // best[2],
                        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(joined).hexdigest(),
                        "collapsed": joined if rows else blobs[a + k],
                    }
                    for name in names:
                        out[name].append(row[name])
            yield replaced(batch, schema, {name: pa.array(values, pa.binary()).cast(pa.string()) if name == "collapsed" else pa.array(values, schema.field(name).type) for name, values in out.items()})

    return run


def find_runs(docs: DataFrame, least: int = 12, texts: bool = True) -> DataFrame:
    """Add to every row its n_words, n_runs, the longest run's start, length,
    period and exponent_milli (null without a run), digests of all runs and of
    the text without repeats, and `collapsed`, that text (unchanged without a
    run). In it each run keeps its first period only. `texts=False` leaves out
    `collapsed` and drops `text`.

    Null and empty texts have no words and no runs. Columns of the added names
    are replaced, all others pass through; rows are judged one by one, so
    repeated rows come out alike. A text is held whole, with 8 bytes a word for
    each power of two up to its length.
    """
    added = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts:
        return with_columns(docs, added + ", collapsed string", lambda schema: _find(schema, least))
    found = with_columns(docs, added, lambda schema: _find(schema, least))
    return found.drop("text")
