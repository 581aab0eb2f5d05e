"""Ordered reductions that stay distributed when one key holds most of the rows.

A plain window puts all rows of a key into one task. The functions here either
reduce before the shuffle (``latest``, ``top_per_key``) or deal the rows out by ranges
of key and order, whatever the values are, work inside the ranges and carry one summary
row per key and range over the borders (``previous_value``, ``running_max``,
``position``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.session import materialize


def spread_nulls(key: Column, *spread: str) -> Column:
    """A join key as text whose NULLs, which match nothing, are dealt out.

    Left as NULL they would all meet in one task.
    """
    return F.coalesce(
        key.cast("string"), F.concat(F.lit("\x00"), F.xxhash64(*spread).cast("string"))
    )


def latest(df: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """The row with the greatest ``order`` per key. ``order`` must be unique."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` tuple per key."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("_row"))
        .select(*keys, "_row.*")
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per key with their rank.

    Spark limits each key to ``n`` rows per input partition before the shuffle,
    so a hot key sends a bounded number of rows to its task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def _directed(order: Sequence[str | tuple[str, bool]]) -> list[tuple[str, Column]]:
    """Names with their sort expressions; (name, True) is descending, NULLs come last."""
    pairs = [o if isinstance(o, tuple) else (o, False) for o in order]
    return [
        (name, F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
        for name, down in pairs
    ]


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, bool]], parts: int | None = None
) -> DataFrame:
    """The rows dealt out by ranges of (keys, order), with ``_part`` and ``_at``.

    ``_at`` numbers the rows in the order over all of them; within one ``_part`` without a
    gap. Ranges come from a sample of the rows, so they are even for sparse and for dense
    values alike, and a key that holds most rows is spread over many of them. Written once:
    ranges drawn anew from another sample would not fit together.
    """
    sort = [F.col(k).asc_nulls_first() for k in keys] + [column for _, column in _directed(order)]
    dealt = df.repartitionByRange(parts, *sort) if parts else df.repartitionByRange(*sort)
    numbered = dealt.sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    # The partition is kept in the bits above 33.
    return materialize(numbered.withColumn("_part", F.shiftright("_at", 33).cast("int")), "ranges")


def _carried(
    ranged: DataFrame, keys: Sequence[str], summary: Column, over_earlier: Column, into: str
) -> DataFrame:
    """One row per key and range after the key's first: ``over_earlier`` of ``_sum`` so far.

    A range border lies inside one key at most, so there are fewer rows than ranges.
    """
    sums = ranged.groupBy(*keys, "_part").agg(summary.alias("_sum"))
    return sums.select(*keys, "_part", over_earlier.alias(into)).filter(F.col(into).isNotNull())


def _earlier(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )


def _with_carried(
    inside: DataFrame, carried: DataFrame, keys: Sequence[str], into: str, value: Column
) -> DataFrame:
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_part")]
    return (
        inside.alias("a")
        .join(carried.alias("b"), on, "left")
        .select("a.*", value.alias(into))
        .drop("_inside", "_part", "_at")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    into: str,
    parts: int | None = None,
) -> DataFrame:
    """``lag(value)`` per key in ``order``; ``value`` must not be null."""
    ranged = in_ranges(df, keys, [order], parts)
    inside = ranged.withColumn(
        "_inside", F.lag(value).over(Window.partitionBy(*keys, "_part").orderBy("_at"))
    )
    carried = _carried(
        ranged, keys, F.max_by(value, "_at"), F.last("_sum").over(_earlier(keys)), "_before"
    )
    return _with_carried(inside, carried, keys, into, F.coalesce("_inside", "_before"))


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str | tuple[str, bool]],
    into: str,
    *,
    coarse: Sequence[tuple[str, bool]] = (),
    descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Exact 1-based row number per key.

    Rows are ordered by the ``coarse`` columns (name, descending) and then by ``order``,
    a name or several. Only one count per range meets in one task.
    """
    last = [(order, descending)] if isinstance(order, str) else list(order)
    ranged = in_ranges(df, keys, [*coarse, *last], parts)
    inside = ranged.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at"))
    )
    carried = _carried(
        ranged, keys, F.count("*"), F.sum("_sum").over(_earlier(keys)), "_offset"
    )
    number = F.col("_inside") + F.coalesce("_offset", F.lit(0).cast("long"))
    return _with_carried(inside, carried, keys, into, number)


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, into: str, parts: int | None = None
) -> DataFrame:
    """Greatest ``value`` of all earlier rows of the key; NULL values do not count."""
    ranged = in_ranges(df, keys, [order], parts)
    before = (
        Window.partitionBy(*keys, "_part").orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = ranged.withColumn("_inside", F.max(value).over(before))
    carried = _carried(ranged, keys, F.max(value), F.max("_sum").over(_earlier(keys)), "_before")
    return _with_carried(inside, carried, keys, into, F.greatest("_inside", "_before"))
