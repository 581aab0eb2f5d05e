"""Collection of one run: configuration, canned items, author and theme finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile, source_kind
from folioflux.functions import catalogue, similarity, text
from folioflux.operators import ordered
from folioflux.operators.changes import ITEM
from folioflux.session import materialize

#: Who may claim an item that several channels bring in.
CHANNEL_ORDER = ["watchlist", "profile_author", "genre_category"]


def configuration(interests: DataFrame, relations: DataFrame, books: DataFrame) -> DataFrame:
    """What a run looks for: core and extended authors, themes and watched books."""
    wanted = interests.filter("active").select(
        "profile_slug",
        F.when(F.col("interest_key") == "thema", "theme").otherwise(F.col("tier")).alias("channel"),
        F.col("value").alias("name"),
        "interest_id",
    )
    watched = (
        relations.filter("active and kind = 'watching'")
        .join(books.select("book_id", "title"), "book_id")
        .select("profile_slug", F.lit("entry").alias("channel"), F.col("title").alias("name"),
                F.lit(None).cast("long").alias("interest_id"))
    )
    return wanted.unionByName(watched)


def authors_to_sweep(interests: DataFrame, include_extended: bool) -> DataFrame:
    """Authors once per profile; core wins where both tiers name one."""
    rows = interests.filter("interest_key = 'author'")
    if not include_extended:
        rows = rows.filter("tier = 'core'")
    return rows.groupBy("profile_slug", "value").agg(F.min("tier").alias("tier"))


def channel_rank(reason: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CHANNEL_ORDER]), reason)


def first_claim(finds: DataFrame) -> DataFrame:
    """One row per item and run: watchlist before author before theme, then by order."""
    ranked = finds.withColumn("_channel", channel_rank(F.col("match_reason")))
    return ordered.first(ranked, [*ITEM, "run_id"], ["_channel", "id"]).drop("_channel")


def canned(items: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Items matched to active entries by case-folded title; the last entry wins."""
    entries = (
        watchlist.filter("active")
        .groupBy(F.lower("title").alias("_title"))
        .agg(F.max_by(F.struct("entry_id", "title", "author", "book_id"), "entry_id").alias("e"))
        .select("_title", "e.entry_id", "e.book_id",
                catalogue.entry_key(F.col("e.title"), F.col("e.author")).alias("watchlist_key"))
    )
    return (
        items.withColumn("_title", F.lower("title"))
        .join(entries, "_title", "left")
        .withColumn("match_reason", F.coalesce("match_reason", F.lit("watchlist")))
        .drop("_title")
    )


def author_matches(wanted: Column, credited: Column, threshold: int = 90) -> Column:
    """Is the wanted person one of the credited ones? Strict form of the name score."""
    scores = similarity.author_scores(
        text.normalize_authors(wanted), text.normalize_authors(credited)
    )
    return scores["strict"] >= threshold


def by_author(hub: DataFrame, search: DataFrame, wanted: str = "author") -> DataFrame:
    """Curated listing of an author if there is one, else strict search hits; once per item.

    Both carry ``(author, source, source_item_id, credited, rank)``.
    """
    # The match is evaluated once per pair of spellings, not once per hit. The scored pairs are
    # written: inside a larger plan the optimizer drops the distinct below the score or copies
    # the score to the other join side.
    pairs = search.select(wanted, "credited").distinct()
    scored = pairs.withColumn("_same", author_matches(F.col(wanted), F.col("credited")))
    good = materialize(scored, "same-author").filter("_same").drop("_same")
    hits = search.join(hub.select(wanted).distinct(), wanted, "left_anti").join(
        good, [wanted, "credited"], "left_semi"
    )
    return ordered.first(
        hub.unionByName(hits), [wanted, "source", "source_item_id"], ["rank"]
    )


def origins(finds: DataFrame, hits: DataFrame, interests: DataFrame) -> DataFrame:
    """Which interest each item comes from: ``interest_id``, and ``found_by`` how many hit it.

    ``hits(profile_slug, source, source_item_id, interest_key, value, id)`` is what the
    searches of a sweep brought; hits of interests no longer active were not asked for.
    The claim goes to the watchlist first (no interest), then to an author, then to a
    theme, and inside a channel to the earlier hit.
    """
    active = interests.filter("active").select("profile_slug", "interest_key", "value", "interest_id")
    reason = F.when(F.col("interest_key") == "author", "profile_author").otherwise("genre_category")
    searched = hits.join(active, ["profile_slug", "interest_key", "value"]).select(
        *ITEM, reason.alias("match_reason"), "id", "interest_id"
    )
    watched = finds.filter("match_reason = 'watchlist'").select(
        *ITEM, "match_reason", "id", F.lit(None).cast("long").alias("interest_id")
    )
    claim = F.struct(channel_rank(F.col("match_reason")).alias("channel"), "id", "match_reason")
    # First one row per item and interest, so a hot item sends few rows on.
    per_interest = searched.unionByName(watched).groupBy(*ITEM, "interest_id").agg(
        F.min(claim).alias("_claim")
    )
    return per_interest.groupBy(*ITEM).agg(
        F.min_by("interest_id", "_claim").alias("interest_id"),
        F.min("_claim")["match_reason"].alias("claimed_as"),
        F.count("interest_id").alias("found_by"),
    )


def swept(interests: DataFrame, sources: DataFrame) -> DataFrame:
    """Every (source, interest) pair of a sweep, recorded even if it finds nothing.

    Both sides are configuration of a profile, joined on the profile.
    """
    return interests.select("profile_slug", "interest_id").join(sources, "profile_slug")


def library_checks(
    entries: DataFrame, links: DataFrame, latest: DataFrame, profile: Profile
) -> DataFrame:
    """Observations a library collects: linked items of active entries that want it."""
    wanted = F.coalesce(
        F.col("restriction") == source_kind(profile, F.col("source")), F.lit(True)
    )
    return (
        entries.filter("active")
        .select("profile_slug", "book_id", "restriction")
        .join(links.filter("source_item_id is not null").select("book_id", "source", "source_item_id"), "book_id")
        .filter(wanted & (source_kind(profile, F.col("source")) == "library"))
        .join(latest, ITEM)
    )
