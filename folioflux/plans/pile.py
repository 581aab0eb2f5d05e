"""The suggestion pile: finds nothing has been said about yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile, source_kind, source_label
from folioflux.functions import catalogue, rules
from folioflux.operators import bundles, lookups
from folioflux.operators.changes import ITEM

STATUSES = ["shown", "hidden_junk", "hidden_priced", "hidden_weak"]


def classified(
    log: DataFrame,
    books: DataFrame,
    links: DataFrame,
    relations: DataFrame,
    ratings: DataFrame,
    edges: DataFrame,
    profile: Profile,
    reason: str | None = None,
) -> DataFrame:
    """Open finds with ``status``: shown, or the first reason that hides them.

    The model rating counts at any confidence and version here. ``reason`` filters
    shown finds only, so the counters of the hidden ones do not depend on it.
    """
    finds = lookups.latest_discoveries(log)
    open_ = lookups.not_covered(
        finds,
        lookups.decided_items(links, relations),
        lookups.decided_isbns(books, relations),
    )
    title_prices, isbn_prices, _ = bundles.price_lists(log)
    priced = bundles.with_advantage(
        open_, title_prices, isbn_prices, edges, profile, keys_from=log,
    ).withColumn(
        "subject", catalogue.subject_of(F.col("isbn"), F.col("source"), F.col("source_item_id"))
    )
    stars = ratings.filter("origin = 'model'").select("subject", "stars", "pitch")
    junk = rules.junk_reason(F.col("price_cents"), F.col("match_reason"), F.col("title"))
    announce = rules.worth_announcing(
        F.col("price_cents"), F.col("match_reason"), F.col("title"), F.col("availability"),
        profile, F.col("advantage").isNotNull(),
    )
    status = (
        F.when(junk.isNotNull(), "hidden_junk")
        .when(~announce, "hidden_priced")
        .when(F.col("stars") < profile.rating_threshold, "hidden_weak")
        .otherwise("shown")
    )
    result = priced.join(stars, "subject", "left").withColumn("status", status)
    if reason:
        result = result.filter(
            (F.col("status") != "shown") | (F.col("match_reason") == reason)
        )
    return result


def suggestions(pile: DataFrame, profile: Profile) -> DataFrame:
    """Shown finds with everything a row displays."""
    return pile.filter("status = 'shown'").select(
        *ITEM, "id", "subject", "title", "author", "stars", "isbn", "price_cents", "match_reason",
        "blurb", "category", "subtitle", "series", "cover_url",
        catalogue.find_key(F.col("source"), F.col("source_item_id")).alias("find_key"),
        rules.is_strong_deal(F.col("price_cents"), profile).alias("deal"),
        source_label(profile, F.col("source")).alias("source_label"),
        source_kind(profile, F.col("source")).alias("source_kind"),
        catalogue.why_shown(F.col("match_reason"), F.col("author"), F.col("category")).alias("why"),
        catalogue.money(F.col("price_cents")).alias("price"),
        F.nullif("pitch", F.lit("")).alias("pitch"),
        F.col("advantage.saved_pct").alias("saved_pct"),
    )


def best_first() -> list:
    """Rated before unrated, then stars, then the newest find."""
    return [
        F.col("stars").isNotNull().desc(), F.col("stars").desc_nulls_last(), F.col("id").desc(),
    ]


def counters(pile: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return pile.groupBy("profile_slug").agg(*counts)


def undo(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Log rows that take decisions back, for finds whose book is known.

    ``links(seq, source, source_item_id, book_id)``: a number stands for the book it was
    linked to last, not for those before.
    """
    books = links.groupBy("source", "source_item_id").agg(F.max_by("book_id", "seq").alias("book_id"))
    return (
        keys.filter(F.col("kind").isin("dismissed", "owned", "watching"))
        .join(books, ["source", "source_item_id"])
        .select("profile_slug", "book_id", "kind", F.lit(False).alias("active"))
    )


def decisions(keys: DataFrame, finds: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Decided finds joined to their latest discovery, and keys of an unknown kind.

    ``keys(profile_slug, source, source_item_id, kind)``. Keys without a find vanish.
    """
    valid = F.col("kind").isin(kinds)
    return keys.filter(valid).join(finds, ITEM), keys.filter(~valid)
