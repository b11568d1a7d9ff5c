"""Orders in which rows are written, so that a reader can skip most of them.

Parquet keeps the least and largest value of each column for every row group. A
reader skips a group whose values cannot meet a predicate, which only works if
groups hold narrow ranges: sorted rows for one key, a space-filling order where
predicates are on either of several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIE = "__tie"
_PLACE = "__place"


def sorted_within(df: DataFrame, partition_by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows gathered by partition value and sorted by `keys` in each file.

    No range shuffle: for tables whose partitions are small enough that sorted
    files alone make row groups narrow.
    """
    gathered = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    return gathered.sortWithinPartitions(*partition_by, *keys)


def clustered(df: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Rows cut into ranges of `keys`, one a file, and sorted in each.

    Ranges come from a sample of the keys; equal keys are cut by a running id,
    so a hot key fills several files. `files` fixes their number, which is
    otherwise that of the shuffle partitions as AQE joins them.
    """
    by = [*partition_by, *keys]
    marked = df.withColumn(_TIE, F.monotonically_increasing_id())
    spread = marked.repartitionByRange(files, *by, _TIE) if files else marked.repartitionByRange(*by, _TIE)
    return spread.sortWithinPartitions(*by).drop(_TIE)


def _rank(df: DataFrame, keys: Sequence[str], bits: int) -> dict[str, Column]:
    """For each key the number of quantiles below it, 0 to 2^bits - 1.

    Quantiles rather than values, so that skewed keys fill the range evenly.
    One aggregate over the table; what it returns has 2^bits numbers a key.
    """
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = {c: F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c in keys}
    found = df.agg(*[F.percentile_approx(numbers[c], cuts, 10 * (1 << bits)).alias(f"q{k}") for k, c in enumerate(keys)]).first()
    ranks = {}
    for k, c in enumerate(keys):
        edges = sorted({float(v) for v in found[k] or ()})
        # Rows without a value come first.
        value = numbers[c].cast("double")
        place = F.size(F.filter(F.lit(edges).cast("array<double>"), _below(value))) if edges else F.lit(0)
        ranks[c] = F.when(F.col(c).isNull(), 0).otherwise(place)
    return ranks


def _below(value: Column):
    return lambda edge: edge < value


def interleaved(ranks: Sequence[Column], bits: int) -> Column:
    """One number from the bits of several, the highest bits of all first."""
    place, out = 0, F.lit(0).cast("bigint")
    for bit in range(bits):
        for rank in reversed(ranks):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint"), place))
            place += 1
    return out


def space_filling(df: DataFrame, keys: Sequence[str], bits: int = 5, files: int | None = None) -> DataFrame:
    """Rows in the order of the interleaved bits of their keys' quantile ranks.

    A predicate on any of the keys then meets about the share of files that the
    root of its selectivity allows. Keys are numbers, dates or timestamps.
    """
    ranks = _rank(df, keys, bits)
    placed = df.withColumn(_PLACE, interleaved([ranks[c] for c in keys], bits)).withColumn(_TIE, F.monotonically_increasing_id())
    spread = placed.repartitionByRange(files, _PLACE, _TIE) if files else placed.repartitionByRange(_PLACE, _TIE)
    return spread.sortWithinPartitions(_PLACE, *keys).drop(_PLACE, _TIE)
