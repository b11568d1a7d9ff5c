"""Expanding parent/child columns: task subtrees, comment threads.

Ancestors are found by pointer doubling: every row points at its parent, then at
its parent's pointer, and so on, so the distance covered doubles each round and
a tree of depth d takes about log2(d) joins of narrow rows (id, pointer,
distance). Rounds are written to the shared folder: a lost executor costs at most
one of them and the plan does not grow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmill.session import cut


def nearest_above(rows: DataFrame, stops: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, stop, distance): the nearest of the given rows at or above each row.

    `stops` has the ids in its first column. Rows below none of them are left
    out, also those that hang on a missing parent or on a cycle without a stop.
    """
    marks = stops.select(F.col(stops.columns[0]).alias("stop")).distinct()
    nodes = rows.select(F.col(id_col).alias("id"), F.col(parent_col).alias("above"))
    here = F.col("stop").isNotNull()
    state = cut(
        nodes.join(marks, F.col("id") == F.col("stop"), "left")
        .select("id", F.when(here, F.col("id")).otherwise(F.col("above")).alias("at"), F.when(here, 0).otherwise(1).cast("bigint").alias("distance"), here.alias("settled"))
        .filter(F.col("at").isNotNull())
    )
    found, going = [state.filter("settled")], state.filter(~F.col("settled"))
    left = most = going.count()
    jumped = 1
    # A row that has passed more rows than there are goes round in a circle.
    while left and jumped <= most:
        known = reduce(DataFrame.union, [*found, going])
        step = going.join(known.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("distance").alias("more"), F.col("settled").alias("end")), "at")
        state = cut(step.select("id", F.col("next").alias("at"), (F.col("distance") + F.col("more")).alias("distance"), F.col("end").alias("settled")))
        found.append(state.filter("settled"))
        going = state.filter(~F.col("settled"))
        left = going.count()
        jumped *= 2
    return reduce(DataFrame.union, found).select("id", F.col("at").alias("stop"), "distance")


def _stops_above(rows: DataFrame, nearest: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(stop, root, more): every stop strictly above each stop, with the distance.

    A round per stop that lies above another; of roots that are not nested none.
    """
    stops = nearest.filter("distance = 0").select(F.col("id").alias("stop"))
    parents = rows.join(stops, F.col(id_col) == F.col("stop"), "left_semi").select(F.col(id_col).alias("stop"), F.col(parent_col).alias("above"))
    up = nearest.select(F.col("id").alias("above"), F.col("stop").alias("root"), (F.col("distance") + 1).alias("more"))
    step = cut(parents.join(up, "above").select("stop", "root", "more").filter("stop <> root"))
    found, fresh = step, step
    while not fresh.isEmpty():
        next_up = step.select(F.col("stop").alias("root"), F.col("root").alias("above"), F.col("more").alias("further"))
        farther = fresh.join(next_up, "root").select("stop", F.col("above").alias("root"), (F.col("more") + F.col("further")).alias("more"))
        fresh = cut(farther.filter("stop <> root").join(found.select("stop", "root"), ["stop", "root"], "left_anti"))
        found = found.union(fresh)
    return found


def descendants(
    rows: DataFrame, roots: DataFrame, id_col: str, parent_col: str, carry: Sequence[str] = (), max_depth: int | None = None
) -> DataFrame:
    """(root_id, id, depth, carry...) for every row at or below the given roots.

    Each row is brought to the nearest root above it by pointer doubling; roots
    below other roots pass their rows on to those. A row has one parent, so a
    cycle is left where it meets a root, and a row is listed once per root.
    """
    start = rows.join(roots.select(F.col(id_col).alias("__root")).distinct(), F.col(id_col) == F.col("__root"), "left_semi")
    nearest = cut(nearest_above(rows, start.select(id_col), id_col, parent_col))
    above = _stops_above(rows, nearest, id_col, parent_col)
    pairs = nearest.select(F.col("stop").alias("root_id"), "id", F.col("distance").alias("depth")).union(
        nearest.join(above, "stop").select("root", "id", F.col("distance") + F.col("more"))
    )
    if max_depth is not None:
        pairs = pairs.filter(F.col("depth") <= max_depth)
    return _shown(pairs, rows, id_col, carry)


def _shown(pairs: DataFrame, rows: DataFrame, id_col: str, carry: Sequence[str]) -> DataFrame:
    """Rows (root_id, id, depth) under their names, with the columns to carry."""
    pairs = pairs.select("root_id", F.col("id").alias(id_col), F.col("depth").cast("int").alias("depth"))
    return pairs.join(rows.select(id_col, *carry), id_col).select("root_id", id_col, "depth", *carry) if carry else pairs


def reachable(rows: DataFrame, ids: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """The given ids (one column) and those of every row below them, each once."""
    given = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    below = nearest_above(rows, given, id_col, parent_col).select(F.col("id").alias(id_col))
    return cut(given.union(below).distinct())


def forest(rows: DataFrame, id_col: str, parent_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Every tree: roots are the rows without a parent, so none lies below another."""
    top = rows.filter(F.col(parent_col).isNull() & F.col(id_col).isNotNull()).select(id_col)
    pairs = nearest_above(rows, top, id_col, parent_col).select(F.col("stop").alias("root_id"), "id", F.col("distance").alias("depth"))
    return _shown(pairs, rows, id_col, carry)


def subtree_counts(tree: DataFrame) -> DataFrame:
    """Size and depth of each root's tree."""
    return tree.groupBy("root_id").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("max_depth"))
