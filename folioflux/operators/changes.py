"""The change feed: every row of a run against the state before that run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions import rules
from folioflux.operators.ordered import spread_nulls

ITEM = ["profile_slug", "source", "source_item_id"]
STATE = ["id", "price_cents", "availability", "reservation_count"]


def state_before_run(
    log: DataFrame, keys: Sequence[str] = ITEM, state: Sequence[str] = STATE
) -> DataFrame:
    """One row per (item, run) with ``previous``: the item's last state in an earlier run.

    The log is first reduced to one state per item and run, so an item that holds
    most rows of the log brings at most one row per run into the window.
    """
    per_run = log.groupBy(*keys, "run_id").agg(
        F.max_by(F.struct(*state), F.col("id")).alias("_state")
    )
    window = Window.partitionBy(*keys).orderBy("run_id")
    return per_run.select(*keys, "run_id", F.lag("_state").over(window).alias("previous"))


def with_previous(
    log: DataFrame, keys: Sequence[str] = ITEM, state: Sequence[str] = STATE
) -> DataFrame:
    """The log with the struct column ``previous``; NULL for the first run of an item."""
    return log.join(state_before_run(log, keys, state), [*keys, "run_id"], "left")


def with_stored_previous(
    current: DataFrame, latest: DataFrame, keys: Sequence[str] = ITEM,
    state: Sequence[str] = STATE,
) -> DataFrame:
    """Observations of one run against the stored latest state of their items."""
    stored = latest.select(*keys, F.struct(*state).alias("previous"))
    return current.join(stored, list(keys), "left")


def change_kinds(profile: Profile, bundle: Column | None = None) -> Column:
    """Array of the changes of a row; price and availability are independent."""
    now, before = F.col("availability"), F.col("previous.availability")
    price, price_before = F.col("price_cents"), F.col("previous.price_cents")
    announce = rules.worth_announcing(
        price, F.col("match_reason"), F.col("title"), now, profile, bundle
    )
    first = F.col("previous").isNull()
    stock = F.when(
        ~first & (now != before),
        F.when(now == "available", "became_available").when(
            before == "available", "became_unavailable"
        ),
    )
    cost = F.when(
        ~first,
        F.when((price < price_before) & announce, "price_drop").when(
            price > price_before, "price_rise"
        ),
    )
    return F.array_compact(F.array(F.when(first & announce, "first_seen"), stock, cost))


def changes(compared: DataFrame, profile: Profile, bundle: Column | None = None) -> DataFrame:
    """One row per change, with ``position`` 0/1 inside the observation."""
    return compared.select(
        "*", F.posexplode(change_kinds(profile, bundle)).alias("position", "kind")
    )


def notifiable(deltas: DataFrame) -> DataFrame:
    return deltas.filter(F.col("kind").isin(rules.NOTIFIABLE))


def suppress_unseeded(
    deltas: DataFrame, origin: DataFrame, seeded: DataFrame, per_source: bool = True
) -> DataFrame:
    """Drop first sightings of interests that this source was never swept for.

    ``origin`` maps a find to its interest, ``seeded`` holds (interest_id, source).
    ``per_source=False`` accepts an interest swept at any source.
    """
    where = ["_interest", "source"] if per_source else ["_interest"]
    marks = (
        seeded.filter("interest_id is not null")
        .withColumn("_interest", F.col("interest_id").cast("string"))
        .select(*where).distinct().withColumn("_seeded", F.lit(True))
    )
    # Most rows have no interest.
    joined = (
        deltas.join(origin, ITEM, "left")
        .withColumn("_interest", spread_nulls(F.col("interest_id"), *ITEM))
        .join(marks, where, "left").drop("_interest")
    )
    quiet = (
        (F.col("kind") == "first_seen")
        & F.col("match_reason").isin(rules.DISCOVERY)
        & F.col("interest_id").isNotNull()
        & F.col("_seeded").isNull()
    )
    return joined.filter(~quiet).drop("_seeded")
