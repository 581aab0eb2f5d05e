"""A reader's decisions on finds: the book, relation and link rows that one decision makes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators import linkage, ordered
from folioflux.session import materialize

NEW, OLD = "new:", "book:"
# ---------------------------------------------------------------- fixed values
CONFIRMED, FROM_THE_PILE = "confirmed", "aus der Triage"
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Decided:
    """New rows of one batch of decisions; they share the ids of the new books."""

    books: DataFrame
    relations: DataFrame
    links: DataFrame


def with_ids(assigned: DataFrame, books: DataFrame) -> DataFrame:
    """``(item_id, book_id, is_new)`` of ``(item_id, book_key)``.

    New books get the numbers after the greatest known one, without a gap, in the order of
    their first items. Numbers come from counts per range, so no task sees all new books,
    and a repeated job gives the same ones.
    """
    first = F.substring("book_key", len(NEW) + 1, 20).cast("long")
    new = assigned.filter(F.col("book_key").startswith(NEW)).select("book_key", first.alias("_first")).distinct()
    numbered = ordered.position(new, [], "_first", "_n").select("book_key", "_n")
    # One row.
    known = books.agg(F.coalesce(F.max("book_id"), F.lit(0)).cast("long").alias("_most"))
    is_new = F.col("_n").isNotNull()
    old = F.substring("book_key", len(OLD) + 1, 20).cast("long")
    return assigned.join(numbered, "book_key", "left").join(F.broadcast(known)).select(
        "item_id", F.when(is_new, F.col("_most") + F.col("_n")).otherwise(old).alias("book_id"), is_new.alias("is_new")
    )


def decide(finds: DataFrame, books: DataFrame, now: Column) -> Decided:
    """What ``finds(id, profile_slug, source, source_item_id, kind, isbn, title, author, series, url)`` add.

    Each find becomes a book, a known one where there is one; the relation goes to that
    book, and the find's place in its catalogue is confirmed as a link of it.
    """
    items = finds.select(F.col("id").alias("item_id"), "isbn", "title", "author", "series").dropDuplicates(["item_id"])
    assigned, after = linkage.find_or_create(items, books)
    placed = materialize(with_ids(materialize(assigned, "decided-keys"), books), "decided-ids")
    numbers = placed.filter("is_new").groupBy("book_id").agg(F.min("item_id").alias("_first"))
    described = after.filter(F.col("book_key").startswith(NEW)).withColumn(
        "_first", F.substring("book_key", len(NEW) + 1, 20).cast("long")
    )
    rows = finds.join(placed, finds["id"] == placed["item_id"])
    return Decided(
        numbers.join(described, "_first").select("book_id", "isbn", "title", "author", "series", now.alias("created_at")),
        rows.select("profile_slug", "book_id", "kind").distinct().withColumns(
            {"active": F.lit(True), "created_at": now}
        ),
        # The last find of a book at a source names its place there.
        ordered.latest(
            rows.select("book_id", "source", "id", "source_item_id", "url"), ["book_id", "source"]
        ).select(
            "book_id", "source", "source_item_id", "url", F.lit(CONFIRMED).alias("outcome"),
            F.lit(FROM_THE_PILE).alias("reason"), now.alias("resolved_at"),
        ),
    )
