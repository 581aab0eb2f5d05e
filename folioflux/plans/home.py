"""Front view, run journal status and profile overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.operators import ordered
from folioflux.plans import pile as piles

KIND_ORDER = ["watching", "owned", "liked", "disliked", "dismissed"]


def offers(entries: DataFrame, profile: Profile) -> DataFrame:
    """Deals by price, then what the library lends, the first few per profile."""
    wanted = entries.filter("active and (deal or borrowable)")
    order = [
        F.col("deal").desc(),
        F.when(F.col("deal"), F.coalesce("price_cents", F.lit(0))).otherwise(0),
        F.lower("title"), F.col("needs_attention").desc(), F.col("book_id"),
    ]
    return ordered.top_per_key(wanted, ["profile_slug"], order, profile.home_offers)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs per profile; runs of one entry do not count."""
    return ordered.top_per_key(
        runs.filter("run_trigger <> 'entry'"), ["profile_slug"], [F.col("run_id").desc()], limit
    )


def last_status(runs: DataFrame, now: Column) -> DataFrame:
    """Last finished run among the five newest, with its age in days."""
    recent = recent_runs(runs, 5).filter("finished_at is not null")
    last = recent.groupBy("profile_slug").agg(
        F.max_by(F.struct("finished_at", "delta_count", "error"), "run_id").alias("r")
    )
    age = F.floor(
        (F.unix_timestamp(now) - F.unix_timestamp(F.col("r.finished_at").cast("timestamp"))) / 86400
    )
    return last.select(
        "profile_slug", "r.*", age.alias("age_days"), (age >= 1).alias("stale"),
        F.col("r.error").isNotNull().alias("failed"),
    )


def summary(
    entries: DataFrame, pile: DataFrame, runs: DataFrame, now: Column
) -> DataFrame:
    """One row per profile."""
    listed = entries.filter("active").groupBy("profile_slug").agg(
        F.count("*").alias("watchlist_total"),
        F.count_if(F.col("deal") | F.col("borrowable")).alias("offers_total"),
    )
    shown = pile.groupBy("profile_slug").agg(
        F.count_if(F.col("status") == "shown").alias("suggestions_total")
    )
    status = last_status(runs, now).select("profile_slug", "age_days", "stale", "failed")
    return listed.join(shown, "profile_slug", "full").join(status, "profile_slug", "left").fillna(
        0, ["watchlist_total", "offers_total", "suggestions_total"]
    )


def home_suggestions(pile: DataFrame, profile: Profile) -> DataFrame:
    rows = piles.suggestions(pile, profile)
    return ordered.top_per_key(
        rows, ["profile_slug"], piles.best_first(), profile.home_suggestions
    )


def shelves(relations: DataFrame, books: DataFrame) -> DataFrame:
    """Books per active relation kind in label order; counts in ``shelf_counts``."""
    order = F.array(*[F.lit(k) for k in KIND_ORDER])
    return (
        relations.filter("active")
        .join(books.select("book_id", "title"), "book_id")
        .select("profile_slug", F.array_position(order, F.col("kind")).alias("place"), "kind",
                "book_id", "title")
    )


def shelf_counts(relations: DataFrame) -> DataFrame:
    return relations.filter("active").groupBy("profile_slug", "kind").agg(
        F.count("*").alias("books")
    )


def next_sweep(last: Column, now: Column) -> Column:
    """Never swept → with the next run; seven days past → overdue; else the date."""
    due = last + F.expr("INTERVAL 7 DAYS")
    return (
        F.when(last.isNull(), "next run").when(due <= now, "overdue")
        .otherwise(F.date_format(due, "dd.MM.yyyy"))
    )


def sweep_due(last: Column, now: Column, weekday: int, has_extended: Column) -> Column:
    """Weekly sweep of the extended authors, or on its weekday if not yet today."""
    week = now - last >= F.expr("INTERVAL 7 DAYS")
    today = (F.weekday(now) == weekday) & (F.to_date(last) < F.to_date(now))
    return has_extended & (last.isNull() | week | today)


def too_soon(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Per profile: is the last run that was not for one entry younger than ``hours``."""
    last = runs.filter("run_trigger <> 'entry'").groupBy("profile_slug").agg(
        F.max_by("started_at", "run_id").alias("started_at")
    )
    young = (
        F.lit(False) if hours <= 0
        else now - F.col("started_at") < F.expr(f"INTERVAL {hours} HOURS")
    )
    return last.select("profile_slug", young.alias("too_soon"))


def journal_status(now: Column) -> Column:
    """A run that never finished counts as abandoned after six hours."""
    return (
        F.when(F.col("finished_at").isNotNull(), F.col("status"))
        .when(now - F.col("started_at") > F.expr("INTERVAL 6 HOURS"), "abandoned")
        .otherwise("running")
    )


def previous_finished(runs: DataFrame) -> DataFrame:
    """For every run the newest finished run before it; runs of one entry do not count.

    Finished runs are reduced to one row per profile and range of run numbers, so a
    profile with most of the runs is not one task.
    """
    marked = runs.withColumn(
        "_finished",
        F.when(
            F.col("finished_at").isNotNull() & (F.col("run_trigger") != "entry"), F.col("run_id")
        ),
    )
    return ordered.running_max(marked, ["profile_slug"], "run_id", "_finished", "previous_run").drop(
        "_finished"
    )


def complaints(runs: DataFrame) -> DataFrame:
    """Error texts of the newest finished run, one row per complaint."""
    newest = runs.filter("finished_at is not null").groupBy("profile_slug").agg(
        F.max_by(F.struct("error"), "run_id").alias("r")
    )
    return newest.select(
        "profile_slug", F.explode(F.split("r.error", ";")).alias("complaint")
    ).withColumn("complaint", F.trim("complaint")).filter("complaint <> ''")


def source_health(names: DataFrame, probes: DataFrame) -> DataFrame:
    """Sources with the state of their last probe."""
    return names.join(probes, "source", "left").withColumn(
        "health",
        F.when(F.col("last_ok").isNull(), "unknown").when(F.col("last_ok"), "ok").otherwise("failing"),
    )
