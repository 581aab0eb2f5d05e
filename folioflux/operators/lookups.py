"""Joins between the log, books, links and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.operators.changes import ITEM
from folioflux.operators.ordered import latest, spread_nulls, top_per_key

HISTORY_LIMIT = 200


def latest_for_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Latest row of the requested items; items never seen keep NULLs."""
    found = latest(log.join(keys, ITEM, "left_semi"), ITEM)
    return keys.join(found, ITEM, "left")


def latest_discoveries(log: DataFrame) -> DataFrame:
    """Latest discovery row per item. The reason is filtered before the reduction."""
    return latest(log.filter(F.col("match_reason").isin("profile_author", "genre_category")), ITEM)


def latest_by_book(log: DataFrame) -> DataFrame:
    """Latest row per profile, book and source."""
    return latest(log.filter("book_id is not null"), ["profile_slug", "book_id", "source"])


def history_of_books(log: DataFrame, links: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest rows per book: rows carrying its id or an item number linked to it.

    The OR becomes two equi-joins; a row that both find is kept once.
    """
    own = log.filter("book_id is not null").withColumn("history_of", F.col("book_id"))
    numbers = (
        links.filter("source_item_id is not null")
        .select("source", "source_item_id", F.col("book_id").alias("history_of"))
        .distinct()
    )
    linked = log.join(numbers, ["source", "source_item_id"]).filter(
        F.col("book_id").isNull() | (F.col("book_id") != F.col("history_of"))
    )
    return top_per_key(
        own.unionByName(linked), ["profile_slug", "history_of"], [F.col("id").desc()], limit
    )


def history_of_items(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    return top_per_key(log, ITEM, [F.col("id").desc()], limit)


def decided_items(links: DataFrame, relations: DataFrame) -> DataFrame:
    """(profile, source, item) of books with any active relation."""
    active = relations.filter("active").select("profile_slug", "book_id").distinct()
    return (
        links.filter("source_item_id is not null")
        .select("book_id", "source", "source_item_id")
        .join(active, "book_id")
        .select(*ITEM)
        .distinct()
    )


def decided_isbns(books: DataFrame, relations: DataFrame) -> DataFrame:
    """(profile, isbn, book_id) of books with any active relation."""
    active = relations.filter("active").select("profile_slug", "book_id").distinct()
    return (
        books.filter("isbn is not null").select("book_id", "isbn").join(active, "book_id")
        .select("profile_slug", "isbn", "book_id")
    )


def dismissed_keys(
    links: DataFrame, books: DataFrame, relations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Item keys and ISBNs of actively dismissed books."""
    dismissed = relations.filter("kind = 'dismissed'")
    items = decided_items(links, dismissed)
    isbns = decided_isbns(books, dismissed).select("profile_slug", "isbn").distinct()
    return items, isbns


def not_covered(finds: DataFrame, items: DataFrame, isbns: DataFrame) -> DataFrame:
    """Finds whose item and ISBN are both absent; a missing ISBN never matches."""
    taken = isbns.filter("isbn is not null").select("profile_slug", F.col("isbn").alias("_isbn")).distinct()
    return (
        finds.join(items, ITEM, "left_anti")
        .withColumn("_isbn", spread_nulls(F.col("isbn"), *ITEM))
        .join(taken, ["profile_slug", "_isbn"], "left_anti")
        .drop("_isbn")
    )
