"""Prices of single volumes and what a bundle saves against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions import rules, text
from folioflux.operators.changes import ITEM
from folioflux.operators.ordered import spread_nulls
from folioflux.session import materialize


def last_prices(log: DataFrame, by: str) -> DataFrame:
    """Cheapest last-known price per (profile, source, ``by``).

    The filter stands before the reduction on purpose: the last row *with* a price
    counts, and only then do free items drop out.
    """
    priced = log.filter(F.col("price_cents").isNotNull() & F.col(by).isNotNull())
    return _cheapest(priced.groupBy(*ITEM).agg(last_priced(by).alias("_last")), "_last", by)


def last_priced(by: str) -> Column:
    """Aggregate of an item: ``by`` and price of its last row that has both."""
    both = F.col("price_cents").isNotNull() & F.col(by).isNotNull()
    return F.max_by(F.struct(by, "price_cents"), F.when(both, F.col("id")))


def _cheapest(items: DataFrame, last: str, by: str) -> DataFrame:
    return (
        items.select("profile_slug", "source", f"{last}.*")
        .filter((F.col("price_cents") > 0) & (F.col(by) != ""))
        .groupBy("profile_slug", "source", by)
        .agg(F.min("price_cents").alias("price_cents"))
    )


def price_lists(log: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``last_prices`` by title and by isbn from one pass over the log, written once.

    The third frame has one row an item with ``more`` aggregates of the same pass.
    """
    items = materialize(
        log.groupBy(*ITEM).agg(
            last_priced("title").alias("_title"), last_priced("isbn").alias("_isbn"), *more
        ),
        "item-prices",
    )
    return (
        _cheapest(items, "_title", "title"), _cheapest(items, "_isbn", "isbn"),
        items.drop("_title", "_isbn"),
    )


def _offers(members: DataFrame, prices: DataFrame, key: str, profile: Profile) -> DataFrame:
    """Per (profile, bundle): number of volumes and, per shop, the sum of all singles.

    A shop counts only if it has a price for every volume.
    """
    shops = F.array(*[F.lit(s) for s in profile.shops()])
    sizes = members.groupBy("profile_slug", key).agg(F.count("*").alias("volumes"))
    sums = (
        members.join(
            prices.filter(F.col("source").isin(profile.shops())), ["profile_slug", "volume"]
        )
        .groupBy("profile_slug", key, "source")
        .agg(F.sum("price_cents").alias("singles"), F.count("*").alias("_priced"))
    )
    complete = (
        sums.join(sizes, ["profile_slug", key])
        .filter(F.col("_priced") == F.col("volumes"))
        # One entry per configured shop, so the list is short.
        .groupBy("profile_slug", key)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.array_position(shops, F.col("source")).alias("shop_pos"),
                        F.col("source").alias("shop"),
                        "singles",
                    )
                )
            ).alias("offers")
        )
    )
    return sizes.join(complete, ["profile_slug", key], "left")


def is_bundle_candidate() -> Column:
    return (
        F.col("match_reason").isin(rules.BUNDLE_REASONS)
        & F.coalesce(F.col("price_cents") > 0, F.lit(False))
        & text.looks_like_bundle(F.col("title"))
    )


def with_advantage(
    finds: DataFrame,
    title_prices: DataFrame,
    isbn_prices: DataFrame,
    edges: DataFrame,
    profile: Profile,
    same_shop: bool = False,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Finds with ``advantage``: struct(volumes, shop, singles, saved_cents, saved_pct) or NULL.

    A record that lists two volumes or more decides alone; otherwise the slash
    form of the title does. The first shop in profile order with a saving wins.
    ``same_shop`` compares only with singles of the find's own shop. ``keys_from``
    may name cheaper rows that contain every bundle of ``finds`` (such as the log
    they come from); the offers are then worked out from those.
    """
    kind = (
        "struct<volumes:bigint,shop:string,singles:bigint,saved_cents:bigint,saved_pct:int>"
    )
    marked = finds.withColumn("_candidate", F.coalesce(is_bundle_candidate(), F.lit(False)))
    # Only the few bundle rows take part in joins; all others pass unshuffled.
    rest = marked.filter(~F.col("_candidate")).drop("_candidate")
    wanted = marked.filter("_candidate").drop("_candidate")

    # Written: offers read the few bundles and their volumes several times.
    bundles = wanted if keys_from is None else keys_from.filter(is_bundle_candidate())
    bundles = materialize(bundles.select("profile_slug", "isbn", "title").distinct(), "bundle-keys")
    records = bundles.filter(F.length("isbn") > 0).select("profile_slug", "isbn").distinct()
    # Edges of no bundle go before the others are made distinct.
    listed = edges.join(records.select("isbn").distinct(), "isbn", "left_semi").select(
        "isbn", F.col("contained").alias("volume")
    ).distinct()
    by_isbn = _offers(
        materialize(records.join(listed, "isbn"), "bundle-volumes"),
        isbn_prices.withColumnRenamed("isbn", "volume"),
        "isbn",
        profile,
    ).select("profile_slug", "isbn", F.col("volumes").alias("_n_isbn"), F.col("offers").alias("_isbn"))
    by_title = _offers(
        bundles.select("profile_slug", "title")
        .distinct()
        .select(
            "profile_slug", "title", F.explode(text.volume_titles(F.col("title"))).alias("volume")
        ),
        title_prices.withColumnRenamed("title", "volume"),
        "title",
        profile,
    ).select("profile_slug", "title", F.col("volumes").alias("_n_title"), F.col("offers").alias("_title"))

    by_record = F.coalesce(F.col("_n_isbn") >= 2, F.lit(False))
    price = F.col("price_cents")

    def saved_pct(offer: Column) -> Column:
        # Half to even, and the rounded value meets the threshold.
        return F.bround((offer["singles"] - price) * 100 / offer["singles"], 0).cast("int")

    def counts(offer: Column) -> Column:
        fits = (offer["singles"] > price) & (saved_pct(offer) >= profile.min_discount_pct)
        return fits & (offer["shop"] == F.col("source")) if same_shop else fits

    chosen = F.try_element_at(
        F.filter(F.when(by_record, F.col("_isbn")).otherwise(F.col("_title")), counts), F.lit(1)
    )
    joined = (
        wanted.withColumn("_isbn_key", spread_nulls(F.col("isbn"), "profile_slug", "title", "source_item_id"))
        .join(by_isbn.withColumnRenamed("isbn", "_isbn_key"), ["profile_slug", "_isbn_key"], "left")
        .join(by_title, ["profile_slug", "title"], "left")
        .withColumn("_offer", chosen)
        .withColumn(
            "advantage",
            F.when(
                F.col("_offer").isNotNull(),
                F.struct(
                    F.when(by_record, F.col("_n_isbn"))
                    .otherwise(F.col("_n_title"))
                    .alias("volumes"),
                    F.col("_offer.shop").alias("shop"),
                    F.col("_offer.singles").alias("singles"),
                    (F.col("_offer.singles") - price).alias("saved_cents"),
                    saved_pct(F.col("_offer")).alias("saved_pct"),
                ),
            ).cast(kind),
        )
        .select(*finds.columns, "advantage")
    )
    return joined.unionByName(rest.withColumn("advantage", F.lit(None).cast(kind)))


def savings(bundles: DataFrame, volumes: DataFrame, singles: DataFrame, min_pct: int) -> DataFrame:
    """Bundle rows against the sum of their volumes (all must have a price).

    ``bundles(bundle_id, price_cents)``, ``volumes(bundle_id, contained)``,
    ``singles(contained, price_cents)``.
    """
    sums = (
        volumes.join(singles, "contained", "left")
        .groupBy("bundle_id")
        .agg(
            F.sum("price_cents").alias("singles_cents"),
            F.bool_and(F.coalesce(F.col("price_cents") > 0, F.lit(False))).alias("_complete"),
            F.count("*").alias("volumes"),
        )
        .filter((F.col("volumes") >= 2) & F.col("_complete"))
    )
    saved = F.col("singles_cents") - F.col("price_cents")
    return (
        bundles.join(sums, "bundle_id")
        .filter((F.col("price_cents") > 0) & (F.col("singles_cents") > F.col("price_cents")))
        .withColumn("saved_cents", saved)
        .withColumn("saved_pct", F.bround(saved * 100 / F.col("singles_cents"), 0).cast("int"))
        .filter(F.col("saved_pct") >= min_pct)
        .drop("_complete")
    )
