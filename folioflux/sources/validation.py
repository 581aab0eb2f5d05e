"""Checks of configuration rows. A check returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
BAG_KEYS = ["tier", "sources", "note", "restrict", "known_missing"]
RESTRICTIONS = ["library", "shop"]
TIERS = ["core", "extended"]
RELATION_KINDS = ["watching", "owned", "liked", "disliked", "dismissed"]
INTEREST_KEYS = ["author", "thema"]
RATING_ORIGINS = ["model", "conversation", "reader", "onleihe_readers"]
LINK_OUTCOMES = ["linked", "confirmed", "unsure", "not_found"]
# ------------------------------------------------------------------------------


def first_violation(rules: dict[str, Column]) -> Column:
    """Name of the first rule a row breaks; the conditions say what is wrong."""
    branches = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return F.coalesce(*branches)


def bag_violations(rows: DataFrame, bag: str) -> DataFrame:
    """Rows whose JSON bag has unknown keys or values no handler serves."""
    details = F.col(bag)
    sources = F.get_json_object(details, "$.sources")
    rules = {
        "unknown key": F.size(
            F.array_except(
                F.json_object_keys(details), F.array(*[F.lit(k) for k in BAG_KEYS])
            )
        )
        > 0,
        "restrict": ~F.get_json_object(details, "$.restrict").isin(RESTRICTIONS),
        "tier": ~F.get_json_object(details, "$.tier").isin(TIERS),
        "sources": sources.isNotNull() & F.from_json(sources, "array<string>").isNull(),
    }
    return rows.withColumn("violation", first_violation(rules)).filter("violation is not null")


def profile_violations(profiles: DataFrame) -> DataFrame:
    """Profile rows with a value out of range."""
    positive = [
        "strong_deal_max_cents", "deal_max_cents", "rating_budget", "batch_size", "run_every_hours",
    ]
    rules = {
        f"{name} not positive": F.col(name) <= 0 for name in positive if name in profiles.columns
    }
    rules["missing slug"] = F.coalesce(F.col("slug"), F.lit("")) == ""
    rules["min_discount_pct not in 0..99"] = ~F.col("min_discount_pct").between(0, 99)
    rules["sweep_weekday not in 0..6"] = ~F.col("sweep_weekday").between(0, 6)
    rules["strong not below deal"] = F.col("strong_deal_max_cents") >= F.col("deal_max_cents")
    return profiles.withColumn("violation", first_violation(rules)).filter("violation is not null")


def watchlist_rows(raw: DataFrame) -> DataFrame:
    """Trimmed entries; a blank author is no author."""
    return raw.withColumn("title", F.trim("title")).withColumn(
        "author", F.nullif(F.trim("author"), F.lit(""))
    )


def watchlist_violations(entries: DataFrame) -> DataFrame:
    """Entries without a title, and every ``title|author`` that occurs twice."""
    from folioflux.functions.catalogue import entry_key

    key = entry_key(F.col("title"), F.col("author"))
    keyed = entries.withColumn("entry_key", key)
    missing = keyed.filter(F.coalesce(F.col("title"), F.lit("")) == "").select(
        "entry_key", F.lit("missing title").alias("violation")
    )
    double = (
        keyed.groupBy("entry_key").agg(F.count("*").alias("n")).filter("n > 1")
        .select("entry_key", F.lit("duplicate").alias("violation"))
    )
    return missing.unionByName(double)


def owned_violations(owned: DataFrame) -> DataFrame:
    rules = {
        "missing title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "stars not in 0..5": ~F.col("stars").between(0, 5) | (F.col("stars") % 1 != 0),
    }
    return owned.withColumn("violation", first_violation(rules)).filter("violation is not null")


def require_none(violations: DataFrame, what: str) -> None:
    """Fail the job while a violation exists; reads at most a few rows."""
    sample = violations.limit(5).collect()
    if sample:
        raise ValueError(f"{what}: {[row.asDict() for row in sample]}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
