"""Histories, sightings and judgements behind a book page or a find page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue, rules
from folioflux.operators import ordered

HISTORY_ROWS = 5
#: Order in which judgements are shown.
ORIGIN_ORDER = ["reader", "conversation", "onleihe_readers", "model"]
AT_THE_FIND = ["model", "onleihe_readers"]


def price_points(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose price differs from the last price before; rows without one are skipped."""
    priced = history.filter("price_cents is not null")
    return (
        ordered.previous_value(priced, keys, "id", "price_cents", "_before")
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col("price_cents")))
        .drop("_before")
    )


def origin_of(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why the newest sighting outside the watchlist was shown."""
    return (
        history.filter("match_reason <> 'watchlist'")
        .groupBy(*keys)
        .agg(F.max_by(F.struct("match_reason", "author", "category", "observed_at", "id"), "id").alias("o"))
        .select(
            *keys,
            F.col("o.match_reason").alias("reason"),
            F.col("o.id").alias("id"),
            catalogue.why_shown(F.col("o.match_reason"), F.col("o.author"), F.col("o.category"))
            .alias("why"),
            F.col("o.observed_at").alias("seen_at"),
        )
    )


def with_other_title(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``other_title`` where a row's title differs from the newest one."""
    newest = history.groupBy(*keys).agg(F.max_by(F.trim("title"), "id").alias("_newest"))
    return (
        history.join(newest, list(keys))
        .withColumn("other_title", F.when(F.trim("title") != F.col("_newest"), F.col("title")))
        .drop("_newest")
    )


def recent_history(history: DataFrame, keys: Sequence[str], n: int = HISTORY_ROWS) -> DataFrame:
    """The newest ``n`` rows per key with the number of rows not shown."""
    sizes = history.groupBy(*keys).agg(F.count("*").alias("_size"))
    return (
        ordered.top_per_key(history, keys, [F.col("id").desc()], n)
        .join(sizes, list(keys))
        .withColumn("hidden", F.greatest(F.col("_size") - n, F.lit(0)))
        .drop("_size")
    )


def judgements(subjects: DataFrame, ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest rating per page and origin.

    ``subjects(keys…, subject, at_book)`` names what a page may look at. What
    people and conversations say counts only at the book.
    """
    found = subjects.distinct().join(ratings, "subject").filter(
        F.col("at_book") | F.col("origin").isin(AT_THE_FIND)
    )
    newest = found.groupBy(*keys, "origin").agg(
        F.max_by(
            F.struct("stars", "confidence", "profile_version", "seq"), F.col("seq")
        ).alias("r")
    )
    order = F.array(*[F.lit(o) for o in ORIGIN_ORDER])
    return newest.select(
        *keys, "origin", F.array_position(order, F.col("origin")).alias("place"), "r.*"
    )


def stale(origin, version, current: int):
    """A profile-bound judgement of another version."""
    return origin.isin(rules.PROFILE_BOUND) & (version != current)
