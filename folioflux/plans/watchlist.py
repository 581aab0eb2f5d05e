"""The watchlist: watched books with their sources and newest observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile, source_kind
from folioflux.functions import rules
from folioflux.operators import lookups

AVAILABILITY_ORDER = ["available", "unavailable", "unknown"]


def watched(relations: DataFrame, include_paused: bool = True) -> DataFrame:
    """``watching`` relations of books that are not actively owned or dismissed."""
    done = relations.filter("active and kind in ('owned', 'dismissed')").select(
        "profile_slug", "book_id"
    )
    rows = relations.filter("kind = 'watching'")
    if not include_paused:
        rows = rows.filter("active")
    return rows.join(done, ["profile_slug", "book_id"], "left_anti")


def best_availability(availability: Column) -> Column:
    """Aggregate: available beats unavailable beats unknown; NULLs do not count."""
    order = F.array(*[F.lit(a) for a in AVAILABILITY_ORDER])
    return F.get(order, F.min(F.nullif(F.array_position(order, availability), F.lit(0))).cast("int") - 1)


def link_flags(links: DataFrame) -> DataFrame:
    """Per book: a question, all sources without a hit, number of sources."""
    unsure = F.col("outcome") == "unsure"
    return links.groupBy("book_id").agg(
        F.bool_or(unsure).alias("needs_attention"),
        F.bool_or(unsure & F.col("matched_title").isNotNull()).alias("_candidates"),
        F.bool_and(F.col("outcome") == "not_found").alias("_all_missing"),
        F.count("*").alias("sources"),
    )


def newest_facts(log: DataFrame) -> DataFrame:
    """Per profile and book over the latest row of each source."""
    latest = lookups.latest_by_book(
        log.select(
            "profile_slug", "book_id", "source", "id", "price_cents", "availability", "observed_at"
        )
    )
    priced = F.when(F.col("price_cents").isNotNull(), F.col("id"))
    return latest.groupBy("profile_slug", "book_id").agg(
        best_availability(F.col("availability")).alias("availability"),
        F.max_by("price_cents", priced).alias("price_cents"),
        F.max_by("observed_at", "id").alias("seen_at"),
    )


def entries(
    log: DataFrame, books: DataFrame, links: DataFrame, relations: DataFrame, profile: Profile,
    include_paused: bool = True,
) -> DataFrame:
    bag = F.from_json("details", "restrict string, note string, known_missing string")
    rows = (
        watched(relations, include_paused)
        .join(books.select("book_id", "title", "author"), "book_id")
        .join(link_flags(links), "book_id", "left")
        .join(newest_facts(log), ["profile_slug", "book_id"], "left")
    )
    found = F.coalesce("sources", F.lit(0))
    return rows.select(
        "profile_slug", "book_id", "title", "author", "active",
        bag["restrict"].alias("restriction"),
        F.coalesce("needs_attention", F.lit(False)).alias("needs_attention"),
        (F.col("active") & F.coalesce("_candidates", F.lit(False))).alias("needs_choice"),
        (F.col("active") & (found > 0) & F.coalesce("_all_missing", F.lit(False))).alias("missing"),
        F.coalesce(bag["known_missing"] == F.col("title"), F.lit(False)).alias("missing_known"),
        (found == 0).alias("unresolved"),
        "availability", "price_cents", "seen_at",
        rules.is_strong_deal(F.col("price_cents"), profile).alias("deal"),
        F.coalesce(F.col("availability") == "available", F.lit(False)).alias("borrowable"),
    )


def reading_order() -> list[Column]:
    return [F.col("needs_attention").desc(), F.lower("title"), F.col("book_id")]


def open_questions(links: DataFrame, relations: DataFrame) -> DataFrame:
    """Unsure links of actively watched books. The JSON field decides, not its text."""
    watching = relations.filter("active and kind = 'watching'").select("profile_slug", "book_id")
    return links.filter("outcome = 'unsure'").join(watching, "book_id")


def wants(restriction: Column, source: Column, profile: Profile) -> Column:
    """An entry may be restricted to libraries or to shops."""
    return F.coalesce(restriction == source_kind(profile, source), F.lit(True))


def link_still_valid(url: Column, resolved_at: Column, now: Column) -> Column:
    """A known address holds; a failed resolution is trusted for seven days."""
    return F.when(url.isNotNull(), True).otherwise(now - resolved_at < F.expr("INTERVAL 7 DAYS"))
