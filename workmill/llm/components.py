"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours on the smallest of them.

    `edges` has u > v. The large star moves the larger neighbours of a node,
    the small star the smaller ones and the node itself.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node that has an edge to another one.

    The label is the smallest node reachable. Null ends and loops say nothing.
    Each round is written to the shared folder, so lineage stays short and a
    lost executor costs one round at most; the number of rounds grows with the
    logarithm of the longest path. Per-node minima combine before the shuffle;
    a node with very many edges is split by the skew join.
    """
    u, v = F.col(a), F.col(b)
    now = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = cut(_stars(_stars(now, large=True), large=False))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
