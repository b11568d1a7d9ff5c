"""Dense surrogate keys without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmill.session import cut


def assign_keys(df: DataFrame, name: str, order_by: Sequence[str] = (), start: int = 1) -> DataFrame:
    """Number rows start, start+1, ... in the order of `order_by`, or where they
    are if no order is asked (runs a job).

    Rows are marked with partition and place and written to the shared folder
    once, so boundaries cannot move between the counting pass and the numbering
    pass. Only an order costs a shuffle: rows are then range-partitioned and
    sorted before. A row's key is its partition's offset
    plus its place in the partition. The offsets are one row per partition, so
    the window and the broadcast below are bounded by the partition count, not
    by the data.
    """
    rows = df
    if order_by:
        # The running id only separates ties, so equal keys can spread over
        # several range partitions instead of filling one.
        tie = "__tie"
        ordered = df.withColumn(tie, F.monotonically_increasing_id())
        cols = [F.col(c).asc_nulls_last() for c in order_by] + [F.col(tie)]
        rows = ordered.repartitionByRange(*cols).sortWithinPartitions(*cols).drop(tie)
    row = "__row"
    # The running id holds the partition above bit 33 and the place below it.
    placed = cut(rows.withColumn(row, F.monotonically_increasing_id()))
    numbered = placed.withColumn("__part", F.shiftright(F.col(row), 33))
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.lit(start) + F.col("__offset") + place).cast("bigint"))
        .select(F.col(name), *[F.col(c) for c in df.columns if c != name])
    )


_WORD = 64  # keys a long has bits for
_SPAN = 512 * _WORD  # keys a row of marks covers


def without_keys(df: DataFrame, name: str, gone: DataFrame, top: int, most: int = 1 << 30) -> DataFrame:
    """Rows of `df` whose dense key (1 to `top`) is not in `gone`; none is NULL.

    The keys in `gone` are marked as bits, a 64th of what the keys themselves
    take, so up to `most` keys (128 MB) they are broadcast and `df` stays where it
    is. Above that both sides shuffle.
    """
    if top > most:
        return df.join(gone.select(name), name, "left_anti")
    bit = F.col(name) - 1
    div = lambda c, by: F.call_function("div", c, F.lit(by))
    words = gone.groupBy(div(bit, _SPAN).alias("__span"), div(bit % _SPAN, _WORD).cast("int").alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % _WORD).cast("int"))).alias("__bits")
    )
    found = F.map_from_entries(F.collect_list(F.struct("__word", "__bits")))
    marks = words.groupBy("__span").agg(found.alias("__found"))
    marks = marks.select("__span", F.transform(F.sequence(F.lit(0), F.lit(_SPAN // _WORD - 1)), lambda w: F.coalesce(F.col("__found")[w], F.lit(0).cast("bigint"))).alias("__marks"))
    word = F.get("__marks", div(bit % _SPAN, _WORD).cast("int"))
    marked = F.call_function("shiftrightunsigned", word, (bit % _WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return df.join(F.broadcast(marks), div(bit, _SPAN) == F.col("__span"), "left").filter(~F.coalesce(marked, F.lit(False))).select(*df.columns)


def fill_keys(df: DataFrame, name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Give rows whose surrogate is NULL the next keys after the largest one."""
    top = df.agg(F.max(name)).first()[0]
    known = df.filter(F.col(name).isNotNull())
    fresh = assign_keys(df.filter(F.col(name).isNull()), name, order_by, start=(top or 0) + 1)
    return known.unionByName(fresh.withColumn(name, F.col(name).cast(df.schema[name].dataType)))
