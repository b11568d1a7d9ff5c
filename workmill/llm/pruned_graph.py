"""Approximate nearest neighbours over robust-pruned graphs, one a shard.

Vectors are dealt to shards by a hash of their id, so a shard has a bounded
number of rows whatever the data, and equal vectors spread over shards. Within a
shard equal vectors are one node. A graph grows by batches: a greedy beam search
from fixed entry points proposes neighbours, and relaxed distance pruning keeps
the near ones that point in different directions; overfull nodes are pruned
again. Every query searches every shard with a beam, in blocks of queries, and
the shards' lists are merged.

For the inner product vectors are lifted to one norm by a further component, so
that the nearest by angle is the one of largest product; scores are products of
the original numbers in double precision. Vectors of a shard are of similar size
(by their largest component), so that a few long ones neither crowd the others
together nor overflow.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.llm.common import rows_at_most
from workmill.session import cut

_ENTRIES = 24  # nodes a search starts from
_WIDE = 4  # nodes expanded a step
_BAND = 4  # powers of two that the sizes of a shard's vectors may span


class Graph:
    """Nodes with at most `degree` neighbours each; absent ones are -1."""

    def __init__(self, points: np.ndarray, degree: int, beam: int, relax: float):
        n = len(points)
        self.points, self.degree, self.relax = points.astype(np.float32), degree, relax
        self.out = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(7).permutation(n)
        self.entries = order[: n if n <= beam else _ENTRIES]
        self._link(self.entries, np.tile(self.entries, (len(self.entries), 1)))
        at = len(self.entries)
        while at < n:
            batch = order[at : at + max(8, min(at // 2, 256))]
            _, _, seen = self.search(self.points[batch], beam, keep=4 * beam)
            self._link(batch, seen)
            at += len(batch)

    def _link(self, nodes: np.ndarray, proposed: np.ndarray) -> None:
        """Give nodes their pruned neighbours, and those an edge back."""
        self.out[nodes] = self._pruned(nodes, np.concatenate([self.out[nodes], proposed], axis=1))
        source = np.repeat(nodes, self.degree)
        target = self.out[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, begin, count = np.unique(target, return_index=True, return_counts=True)
        if not len(touched):
            return
        new = np.full((len(touched), int(count.max())), -1, np.int32)
        row = np.repeat(np.arange(len(touched)), count)
        new[row, np.arange(len(target)) - begin[row]] = source
        both = np.concatenate([self.out[touched], new], axis=1)
        for k in range(0, len(touched), 256):
            self.out[touched[k : k + 256]] = self._pruned(touched[k : k + 256], both[k : k + 256])

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Nearest first; what a kept one is nearer to, by the factor, goes."""
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == nodes[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        vectors = self.points[np.maximum(candidates, 0)]
        gap = np.square(vectors - self.points[nodes][:, None]).sum(axis=2)
        gap[bad] = np.inf
        out, rows = np.full((len(nodes), self.degree), -1, np.int32), np.arange(len(nodes))
        for k in range(self.degree):
            best = gap.argmin(axis=1)
            live = np.isfinite(gap[rows, best])
            if not live.any():
                break
            out[live, k] = candidates[rows, best][live]
            apart = np.square(vectors - vectors[rows, best][:, None]).sum(axis=2)
            gap[(self.relax**2 * apart <= gap) & live[:, None]] = np.inf
            gap[rows, best] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int, keep: int = 0):
        """Per query: the nearest nodes met, their distances, and all expanded."""
        count, n, rows = len(queries), len(self.points), np.arange(len(queries))[:, None]
        width = max(beam, len(self.entries))
        ids = np.full((count, width), -1, np.int32)
        far = np.full((count, width), np.inf, np.float32)
        ids[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = self._far(queries, ids[:, : len(self.entries)])
        met = np.zeros((count, n), bool)
        met[:, self.entries] = True
        done = ~np.isfinite(far)
        trail = []
        while not done.all():
            open_far = np.where(done, np.inf, far)
            pick = np.argpartition(open_far, min(_WIDE, width - 1), axis=1)[:, :_WIDE]
            live = np.isfinite(open_far[rows, pick])
            node = np.where(live, ids[rows, pick], -1)
            done[rows, pick] = True
            trail.append(node)
            near = np.where(node[:, :, None] >= 0, self.out[np.maximum(node, 0)], -1).reshape(count, -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~met[rows, np.maximum(near, 0)]
            who = np.broadcast_to(rows, near.shape)[fresh]
            met[who, near[fresh]] = True
            distance = np.full(near.shape, np.inf, np.float32)
            distance[fresh] = np.square(self.points[near[fresh]] - queries[who]).sum(axis=1)
            ids, far, done = np.concatenate([ids, near], axis=1), np.concatenate([far, distance], axis=1), np.concatenate([done, ~fresh], axis=1)
            best = np.argpartition(far, width - 1, axis=1)[:, :width]
            ids, far, done = ids[rows, best], far[rows, best], done[rows, best]
        seen = np.concatenate([ids, *trail], axis=1)[:, :keep] if keep else None
        return ids, far, seen

    def _far(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.square(self.points[ids] - queries[:, None]).sum(axis=2)


def _build(degree, beam, relax, top):
    def run(key, rows):
        vectors = np.array(rows["vector"].tolist(), np.float64)
        order = np.lexsort((rows["vec_id"].to_numpy(), *vectors.T[::-1]))
        ids, vectors = rows["vec_id"].to_numpy()[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        begin = np.flatnonzero(new)
        own = [part[: top + 1] for part in np.split(ids, begin[1:])]  # a query may drop one
        nodes = vectors[begin]
        # Brought near 1 by a common factor before anything is squared.
        small = nodes / np.abs(nodes).max()
        norm = np.square(small).sum(axis=1)
        lifted = np.c_[small, np.sqrt(norm.max() - norm)]
        graph = Graph(lifted / np.sqrt(norm.max()), degree, beam, relax)
        return pd.DataFrame({"dims": [key[0]], "shard": [key[1]], "graph": [pickle.dumps((graph, nodes, own))]})

    return run


def _order(hit: tuple[float, int]) -> tuple:
    """Largest product first, one that is no number last."""
    return hit[0] != hit[0], *hit


def _search(beam, top):
    def run(key, graphs, queries):
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "shard": np.zeros(0, np.int32), "found": np.zeros(0, object)})
        graph, nodes, own = pickle.loads(graphs["graph"].iloc[0])
        name, vector = queries["vec_id"].to_numpy(), np.array(queries["vector"].tolist(), np.float64)
        small = vector / np.abs(vector).max(axis=1, keepdims=True)
        small /= np.sqrt(np.square(small).sum(axis=1, keepdims=True))
        ids, far, _ = graph.search(np.c_[small, np.zeros(len(small))].astype(np.float32), beam)
        found = []
        for k in range(len(name)):
            near = ids[k][np.isfinite(far[k])]
            score = np.einsum("ij,j->i", nodes[near], vector[k])
            hits = [(float(-s), int(i)) for s, node in zip(score, near, strict=True) for i in own[node] if i != name[k]]
            found.append([{"less": s, "vec_id": i} for s, i in sorted(hits, key=_order)[:top]])
        return pd.DataFrame({"query_id": name, "shard": key[1], "found": found})

    return run


def nearest(embeddings: DataFrame, queries: DataFrame, top: int = 20, shard_rows: int = 3000, degree: int = 28, beam: int = 64, search_beam: int = 96, relax: float = 1.2, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of every query.

    Both inputs have vec_id and embedding. Nearest is the largest inner product
    in double precision, ties to the smaller vec_id; a query's own id is left
    out. Null ids and vectors that are null, empty, zero or hold a null or
    non-finite number take no part. Vectors of different length never meet.
    Rows that repeat an id count once, with the smallest vector. Fewer
    candidates than `top`: all of them. No rows: no rows.
    """
    spark = embeddings.sparkSession

    def valid(df):
        vector = F.transform("embedding", lambda x: x.cast("double"))
        good = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL").where(good)
        return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))

    points, asked = cut(valid(embeddings)), cut(valid(queries))
    # Vectors of one shard are alike in size, within `_BAND` powers of two: bands are few, whatever the rows.
    size = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    banded = points.withColumn("band", F.floor(F.log2(size) / _BAND).cast("int"))
    bands = dict(rows_at_most(banded.groupBy("band").count(), 600))  # doubles have fewer
    blocks = max(1, -(-asked.count() // block))
    # Each band has as many shards as its rows ask for, numbered one after the other.
    first, many, shards = [], [], 0
    for band, count in sorted(bands.items()):
        own = -(-count // shard_rows)
        first += [F.lit(band), F.lit(shards)]
        many += [F.lit(band), F.lit(own)]
        shards += own
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shard = F.element_at(F.create_map(*first), F.col("band")) + F.pmod(F.xxhash64("vec_id"), F.element_at(F.create_map(*many), F.col("band")))
    placed = banded.withColumn("shard", shard.cast("int")).drop("band")
    graphs = cut(placed.groupBy("dims", "shard").applyInPandas(_build(degree, beam, relax, top), "dims int, shard int, graph binary"))
    each_block = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each_shard = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dims", "shard", "block")
    found = each_block.groupBy(*keys).cogroup(each_shard.groupBy(*keys)).applyInPandas(_search(search_beam, top), "query_id long, shard int, found array<struct<less: double, vec_id: long>>")
    # Lists merge by levels, so that no task holds the lists of all shards.
    for part in (F.col("shard").cast("int") % 1024, F.lit(0)):
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top)
        found = found.groupBy("query_id", part.alias("shard")).agg(merged.alias("found"))
    ranked = found.select("query_id", F.posexplode("found").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
