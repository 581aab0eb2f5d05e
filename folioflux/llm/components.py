"""Connected components of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import written


def _state(links: DataFrame) -> tuple:
    """A count and an order-free sum over the rows; equal when nothing has changed."""
    mark = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the node's smallest one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "w").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("w"))
    joined = links.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("w").alias("v"))
        .where("u <> v")
        .union(least.select("u", F.col("w").alias("v")))
        .distinct()
    )


def smallest_reachable(links: DataFrame, name: str) -> DataFrame:
    """Links (u, v) of longs to stars: (u, v) with v the smallest node u reaches, v < u.

    Minima are summed up before they meet, and joins are on plain keys, so a node with
    very many links can be split. Each round is written to the shared folder.
    """
    links = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-links",
    )
    before = _state(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), f"{name}-stars")
        after = _state(links)
        if after == before:
            break
        before = after
    return links
