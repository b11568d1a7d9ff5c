"""N-gram Jaccard join: near-duplicate documents and their components.

Method: prefix filtering under several global token orders. In any fixed order
of all tokens, two sets of similarity s share a token among the first
n - ceil(s n) + 1 of each. Three orders are used (tokens of few texts first, hash
descending, a second hash): candidates come from shared prefix tokens of the
first and must share one under the others too, before whole sets are compared.

Ahead of that stands an exact test per document: at least ceil(s n) of its
tokens must occur in some other text, so of its first n - ceil(s n) + c tokens
at least c. Documents that fail link with nothing and are not read again.

Equal sets are one class, so copies never meet in pairs. Within the documents
of a prefix token, all are compared with one of them, the pivot, and what links
falls into one component; only documents of different components are compared
further. A large group of near copies so costs its size, not its square. Groups
that do not fall together are compared pair by pair in the end, so no link that
joins two components is lost. Pivot rounds only save work.

Sets are 64-bit shingle hashes; one set is in a task at a time, beside a batch
of about two megabytes of text. Shingles are counted in `_SHARES` shares of their
hashes, one after the other, and tables go once they are used, which bounds the
disk. Classes that hold a thousandth of all rows, of which there are a thousand at
most, reach their rows by a broadcast.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import LOWER, blobs_of, chunks, discard, lists, release, rolling, tidy, word_hashes
from workmill.llm.components import components
from workmill.session import cut

_FACTOR = 0x9E3779B97F4A7C15
_REMIX = np.uint64(0xD6E8FEB86659FD93)
_SHARES = 4
_HOT = 1000


def _ceil(n, percent: int):
    return (n * percent + 99) // 100


def _sets(blobs: list[bytes], width: int):
    """Sorted distinct shingle hashes of each text."""
    h, at = word_hashes(blobs, LOWER)
    full = rolling(h, width, _FACTOR)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        else:
            yield rolling(h[a:b], b - a, _FACTOR) if b > a else h[:0]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _signed(tokens: np.ndarray) -> np.ndarray:
    """Hash order kept in signed numbers."""
    return (tokens ^ np.uint64(1 << 63)).view(np.int64)


def _prefixes(width, percent):
    def run(batches):
        for batch in batches:
            texts, ids, hashes = blobs_of(batch, "text"), batch.column("doc_id"), batch.column("text_hash")
            for i, j in chunks(texts):
                size, digest, need, parts = [], [], [], []
                for tokens in _sets(texts[i:j], width):
                    n = len(tokens)
                    size.append(n)
                    digest.append(_digest(tokens) if n else None)
                    need.append(max(1, n // 20))
                    parts.append(_signed(tokens[: n - _ceil(n, percent) + need[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), hashes.slice(i, j - i), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(need, pa.int64()), lists(np.concatenate(parts), [len(p) for p in parts], pa.int64())],
                    names=["doc_id", "text_hash", "n", "digest", "need", "prefix"],
                )

    return run


def _whole_sets(width, percent):
    def run(batches):
        for batch in batches:
            texts, nodes, digests = blobs_of(batch, "text"), batch.column("node").to_pylist(), batch.column("digest").to_pylist()
            for i, j in chunks(texts):
                keep, size, tokens_of, third = [], [], [], []
                for k, tokens in enumerate(_sets(texts[i:j], width), i):
                    if _digest(tokens) != digests[k]:
                        continue  # another text under a repeated id
                    keep.append(nodes[k])
                    size.append(len(tokens))
                    tokens_of.append(_signed(tokens))
                    third.append(np.sort(_signed(tokens * _REMIX))[: len(tokens) - _ceil(len(tokens), percent) + 1])
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keep, pa.int64()), pa.array(size, pa.int64()), lists(np.concatenate(tokens_of), size, pa.int64()), lists(np.concatenate(third), [len(t) for t in third], pa.int64())],
                        names=["node", "n", "tokens", "third"],
                    )

    return run


def _prefix_size(n: str, percent: int) -> Column:
    return F.expr(f"CAST({n} - ({n} * {percent} + 99) DIV 100 + 1 AS INT)")


def _compatible(n_a: str, n_b: str, common: str, percent: int) -> str:
    """Could sets of these sizes link with so many tokens in common?"""
    return f"100 * {common} >= {percent} * ({n_a} + {n_b} - {common})"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes meet in every order and whose sets link."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "tokens", "third")]), side)
    last = [F.slice(f"tokens_{s}", -_prefix_size(f"n_{s}", percent), _prefix_size(f"n_{s}", percent)) for s in ("a", "b")]
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    filtered = pairs.where(F.arrays_overlap(*last)).where(F.arrays_overlap("third_a", "third_b"))
    return filtered.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components of the linked ends fell together."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side)
    moved = components(ends.select("la", "lb"), "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("to"))
    new = cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    discard(labels, links)
    return new


def _shares(token: DataFrame) -> list[DataFrame]:
    """The tokens in shares of their hashes (not of their low bits, by which nothing else goes)."""
    return [token.where(F.pmod(F.shiftrightunsigned("tok", 7), F.lit(_SHARES)) == k) for k in range(_SHARES)]


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(tok, node, n, left, central): each set's prefix, tokens of few texts first.

    The order is (number of texts, hash). Tokens of one text come first and
    meet nothing, so only what remains of the prefix is listed. Sets with too
    few tokens in other texts can link with nothing and drop out. `left` counts
    the set's tokens from here on: two sets that share this token and none
    before it have at most the smaller `left` in common. `central` is the share
    of tokens met in other texts.
    """
    token = sets.select("node", "n", F.explode("tokens").alias("tok"))
    met = []
    for share in _shares(token):
        spread = share.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
        met.append(cut(share.join(spread, "tok").select("node", "n", "df", "tok")))
        release(sets.sparkSession)
    common = reduce(DataFrame.unionAll, met).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("common"))
    rest = _prefix_size("n", percent) - (F.col("n").cast("int") - F.size("common"))
    listed = common.where(rest > 0).select("node", "n", F.size("common").alias("s"), F.posexplode(F.slice("common", F.lit(1), rest)).alias("pos", "c"))
    groups = cut(listed.select("c.tok", "node", "n", F.expr("CAST(s - pos AS BIGINT) AS left"), F.expr("1000 * s DIV n AS central")))
    discard(*met)
    return groups


def _grouped(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Component labels of all nodes that have a set."""
    labels = cut(sets.select("node", F.col("node").alias("label")).distinct())
    before = float("inf")
    while True:
        here = groups.join(labels, "node")
        part = here.groupBy("tok", "label").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"), "node", "n", "left", "label")).alias("pivot"), F.min("n").alias("least_n"), F.count("*").alias("c"))
        group = part.groupBy("tok").agg(F.max("pivot").alias("pivot"), F.min("least_n").alias("least_n"), F.count("*").alias("parts"), F.sum("c").alias("rows"), F.sum(F.expr("c * CAST(c AS DOUBLE)")).alias("same"), F.max(F.struct("c", "label")).alias("top"))
        active = cut(group.where("parts > 1").select("tok", "pivot", "least_n", "rows", (F.col("rows") * F.col("rows") - F.col("same")).alias("pairs"), F.col("top.label").alias("top")))
        rows, pairs = active.agg(F.sum("rows"), F.sum("pairs")).first()
        if not rows:
            discard(active, groups)
            return labels
        # A row goes that could not even link with the group's smallest set.
        met = here.join(active, "tok").where(_compatible("n", "least_n", "left", percent))
        if pairs <= 8 * rows or pairs > 0.7 * before:
            break  # few pairs, or pivots no longer help
        before = pairs
        old, groups = groups, cut(met.where("node != pivot.node").select(*groups.columns))
        found = met.where("label != pivot.label").where(_compatible("n", "pivot.n", "least(left, pivot.left)", percent)).select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
        links = cut(_verified(found, sets, percent))
        labels = _relabel(labels, links)
        discard(old, active)
        release(sets.sparkSession)
    # Every pair of two components has an end outside its group's largest one.
    sides = [met.where(where).select("tok", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "left", "label")]) for s, where in (("a", "label != top"), ("b", "true"))]
    found = sides[0].join(sides[1], "tok").where("label_a != label_b").where(_compatible("n_a", "n_b", "least(left_a, left_b)", percent))
    found = found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    labels = _relabel(labels, cut(_verified(found, sets, percent)))
    discard(groups, active)
    return labels


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Words stand between ASCII white space, A-Z lower-cased. A text's set holds
    its distinct shingles of `width` words, or its whole sequence of fewer
    words. Two texts link when 100 * common >= percent * all of both sets;
    component_id is the smallest doc_id reachable by links.

    No text or no words: an empty set, linked with nothing. A null doc_id: the
    set is counted, component_id is null and nothing links through the row.
    Rows that repeat an id are judged each by its own text; `text_hash` adds a
    hash of the text as it is, which tells them apart. No rows: no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = cut(narrow.mapInArrow(tidy(_prefixes(width, percent)), "doc_id long, text_hash long, n long, digest binary, need long, prefix array<long>"))
    rows = cut(found.select("doc_id", "text_hash", "n", "digest"))
    named = rows.where("doc_id IS NOT NULL AND n > 0")
    token = found.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "need", F.xxhash64("digest").alias("text"), F.explode("prefix").alias("tok"))
    counts = []
    for share in _shares(token):
        shared = share.groupBy("tok").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo < hi").select("tok")
        counts.append(cut(share.join(shared, "tok", "left_semi").groupBy("doc_id", "text", "need").agg(F.count("*").alias("common"))))
        release(spark)
    enough = reduce(DataFrame.unionAll, counts).groupBy("doc_id", "text", "need").agg(F.sum("common").alias("common")).where("common >= need").select("doc_id", "text")
    able = named.select("doc_id", "digest", F.xxhash64("digest").alias("text")).join(enough, ["doc_id", "text"], "left_semi")
    classes = cut(able.groupBy("digest").agg(F.min("doc_id").alias("node")))
    discard(found, *counts)
    release(spark)
    parts = []
    for k in range(_SHARES):  # of the documents: texts shuffle once, a share at a time
        own = F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)) == k
        chosen = classes.select(F.col("node").alias("doc_id"), "node", "digest").where(own)
        texts = narrow.where(own).join(chosen.hint("shuffle_hash"), "doc_id")
        parts.append(cut(texts.select("node", "digest", "text").mapInArrow(tidy(_whole_sets(width, percent)), "node long, n long, tokens array<long>, third array<long>")))
        release(spark)
    sets = reduce(DataFrame.unionAll, parts)
    groups = _rare_first(sets, percent)
    release(spark)
    labels = _grouped(groups, sets, percent)
    # Every class of equal sets, also of documents that failed the test above.
    found = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("c"))
    all_classes = cut(found.join(labels, "node", "left").select("digest", "c", F.coalesce("label", "node").alias("label")))
    discard(labels, sets, classes)
    release(spark)
    total = rows.count()
    hot = all_classes.where(F.col("c") * _HOT > total).select("digest", F.col("label").alias("hot"))
    out = rows.join(F.broadcast(hot), "digest", "left")  # fewer than _HOT rows
    # Rows that need no class any more, or have none, are spread by their ids.
    key = F.when(F.col("hot").isNull(), F.hex("digest"))
    out = out.withColumn("_key", F.coalesce(key, F.xxhash64("doc_id").cast("string"))).join(all_classes.select(F.hex("digest").alias("_key"), "label"), "_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("hot", "label")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *(["text_hash"] if text_hash else []))
