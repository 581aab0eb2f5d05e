"""The relevance gate: which deltas reach the reader, and the backlog to be rated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions import catalogue, rules
from folioflux.operators import ordered

JUDGEMENT = ["stars", "confidence", "reason", "pitch"]


def _current(ratings: DataFrame, origin: str, version: int, name: str, key: str) -> DataFrame:
    """Ratings of one origin that still hold, as one struct per subject."""
    return ratings.filter(
        (F.col("origin") == origin) & rules.still_valid(F.col("origin"), F.col("profile_version"), version)
    ).select(F.col("subject").alias(key), F.struct(*JUDGEMENT).alias(name))


def with_judgement(finds: DataFrame, ratings: DataFrame, version: int) -> DataFrame:
    """``judgement``: reader before conversation (both at the book) before model (at the find)."""
    keyed = finds.withColumn(
        "subject",
        catalogue.subject_of(F.col("isbn"), F.col("source"), F.col("source_item_id")),
    ).withColumn("_book", catalogue.book_subject(F.col("book_id")))
    # Finds without a book skip the book joins, so their NULLs never meet in one task.
    at_book = keyed.filter("_book is not null")
    no_book = keyed.filter("_book is null")
    none = F.lit(None).cast(
        "struct<stars:double,confidence:string,reason:string,pitch:string>"
    )
    judged = (
        at_book.join(_current(ratings, "reader", version, "_reader", "_book"), "_book", "left")
        .join(_current(ratings, "conversation", version, "_talk", "_book"), "_book", "left")
        .unionByName(no_book.withColumn("_reader", none).withColumn("_talk", none))
    )
    return (
        judged.join(_current(ratings, "model", version, "_model", "subject"), "subject", "left")
        .withColumn("judgement", F.coalesce("_reader", "_talk", "_model"))
        .drop("_reader", "_talk", "_model", "_book")
    )


def is_discovery() -> Column:
    return (F.col("kind") == "first_seen") & (F.col("match_reason") != "watchlist")


def to_ask(judged: DataFrame, budget: int, run: list[str]) -> DataFrame:
    """The first ``budget`` unjudged discoveries of each run in delta order."""
    open_ = judged.filter(is_discovery() & F.col("judgement").isNull())
    return ordered.top_per_key(open_, run, [F.col("id").asc()], budget, "ask_rank")


def apply(
    deltas: DataFrame,
    ratings: DataFrame,
    profile: Profile,
    run: list[str],
    rate: Callable[[DataFrame], DataFrame] | None,
    full_blurbs: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Deltas with ``decision`` and ``shown``.

    ``rate`` turns the asked finds into (id, stars, confidence, reason, pitch); a
    find it leaves out stays unrated and is shown. ``full_blurbs`` may complete the
    texts first. Without a rater the gate lets everything through.
    """
    if rate is None:
        return deltas.withColumn(
            "decision", F.when(is_discovery(), "unrated").otherwise("kept")
        ).withColumn("shown", F.lit(True))

    judged = with_judgement(deltas, ratings, profile.profile_version)
    asked = to_ask(judged, profile.rating_budget, run)
    texts = asked if full_blurbs is None else asked.transform(full_blurbs)
    fresh = texts.transform(rate).select("id", F.struct(*JUDGEMENT).alias("_fresh"))
    # At most ``budget`` rows per run meet the deltas again.
    marks = asked.select("id", F.lit(True).alias("_asked")).join(fresh, "id", "left")
    joined = judged.join(marks, "id", "left")

    stored, new = F.col("judgement"), F.when(is_discovery(), F.col("_fresh"))
    used = F.coalesce(stored, new)
    limit = profile.rating_threshold
    held = rules.withholds(used["stars"], used["confidence"], limit)
    unsure = ~rules.passes(used["stars"], limit)
    decision = (
        F.when(F.col("match_reason") == "watchlist", "kept")
        .when(used.isNotNull() & held, "held_back")
        .when(used.isNotNull() & unsure, "shown_unsure")
        .when(stored.isNotNull(), "reused")
        .when(F.col("kind") != "first_seen", "kept")
        .when(F.col("_asked").isNull(), "over_budget")
        .when(new.isNull(), "unrated")
        .otherwise("rated")
    )
    return (
        joined.withColumn("decision", decision)
        .withColumn("shown", F.col("decision") != "held_back")
        .withColumn(
            "from_store", stored.isNotNull() & (F.col("match_reason") != "watchlist")
        )
        .withColumn("newly_rated", stored.isNull() & new.isNotNull() & is_discovery())
        .withColumn("judgement", F.when(F.col("match_reason") != "watchlist", used))
        .drop("_asked", "_fresh")
    )


def report(decided: DataFrame, by: list[str]) -> DataFrame:
    """Counters of the gate per run."""
    return decided.groupBy(*by).agg(
        F.count_if(F.col("decision") == "held_back").alias("held_back"),
        F.count_if("newly_rated").alias("rated"),
        F.count_if("from_store").alias("reused"),
        F.count_if(F.col("decision") == "unrated").alias("unrated"),
        F.count_if(F.col("decision") == "over_budget").alias("over_budget"),
        F.count_if(F.col("decision") == "shown_unsure").alias("shown_unsure"),
    )


def without_current_rating(finds: DataFrame, ratings: DataFrame, version: int) -> DataFrame:
    """Finds with no model rating, or one for another profile version."""
    current = ratings.filter(
        (F.col("origin") == "model") & (F.col("profile_version") == version)
    ).select("subject")
    return finds.join(current, "subject", "left_anti")


def batches(finds: DataFrame, size: int, keys: list[str], into: str = "batch") -> DataFrame:
    """Number finds into batches of at most ``size`` in id order, per key."""
    numbered = ordered.position(finds, keys, "id", "_position")
    return (
        numbered.withColumn(into, F.floor((F.col("_position") - 1) / size))
        .withColumn("number", ((F.col("_position") - 1) % size + 1).cast("int"))
        .drop("_position")
    )


def batch_prompts(batched: DataFrame, keys: list[str]) -> DataFrame:
    """One text per batch: numbered blocks of facts. A batch is small by construction."""
    block = F.concat(
        F.lit("--- BUCH "), F.col("number"), F.lit(" ---\n"),
        catalogue.book_facts(
            F.col("title"), F.col("subtitle"), F.col("author"), F.col("series"),
            F.col("category"), F.col("price_cents"), F.col("blurb"),
        ),
    )
    return batched.groupBy(*keys, "batch").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("number", block.alias("block")))),
                lambda b: b["block"],
            ),
            "\n\n",
        ).alias("prompt"),
        F.count("*").alias("books"),
    )


#: Fixed value: the shape of one entry of an answer.
ANSWER = "map<string,struct<stars:string,confidence:string,reason:string,pitch:string>>"


def parse_answers(
    answers: DataFrame, batched: DataFrame, keys: list[str], confidences: list[str],
    lowest: int = 0, highest: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Answers ``(keys…, batch, answer)`` read per book: accepted ratings and rejects.

    One bad entry costs one book. A backslash before an apostrophe is repaired.
    """
    text = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    repaired = F.replace(text, F.lit("\\'"), F.lit("'"))
    # Only a text that is not valid as it stands gets the repair.
    read = F.coalesce(F.from_json(text, ANSWER), F.from_json(repaired, ANSWER))
    entries = answers.select(*keys, "batch", F.explode(read).alias("number", "entry")).withColumn(
        "number", F.expr("try_cast(number as int)")
    )
    joined = batched.join(entries, [*keys, "batch", "number"], "left")
    stars = F.when(F.col("entry.stars").rlike(r"^\s*-?\d+(\.\d+)?\s*$"),
                   F.expr("cast(try_cast(trim(entry.stars) as double) as int)"))
    confidence = F.lower(F.trim("entry.confidence"))
    reason = F.nullif(F.trim("entry.reason"), F.lit(""))
    checked = (
        joined.withColumn("stars", stars)
        .withColumn("confidence", confidence)
        .withColumn("answer_reason", reason)
        .withColumn("pitch", F.coalesce(F.trim("entry.pitch"), F.lit("")))
        .withColumn(
            "problem",
            F.when(F.col("entry").isNull(), "no entry")
            .when(F.col("stars").isNull() | ~F.col("stars").between(lowest, highest), "stars")
            .when(F.coalesce(~F.col("confidence").isin(confidences), F.lit(True)), "confidence")
            .when(F.col("answer_reason").isNull(), "reason"),
        )
        .drop("entry")
    )
    return checked.filter("problem is null"), checked.filter("problem is not null")
