"""Price, junk and announce rules as boolean and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions.text import BUNDLE_PATTERN

# ---------------------------------------------------------------- fixed values
STRONG_DEAL = "Strong Deal"
DEAL = "Deal"
JUNK_FREE = "gratis"
JUNK_BUNDLE = "Sammelband"
JUNK_EPISODE = "Fortsetzungsheft"
EPISODE_PATTERN = r"(?iuU)\b(?:Episode|Folge)\s*\d+"
NOTIFIABLE = ["first_seen", "became_available", "price_drop"]
DISCOVERY = ["profile_author", "genre_category"]
#: Reasons for which a bundle may be reported at all.
BUNDLE_REASONS = ["watchlist", "profile_author"]
#: Origins whose judgement holds for one profile version only.
PROFILE_BOUND = ["model", "conversation"]
GUESSED = "vermutet"
# ------------------------------------------------------------------------------


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_strong_deal(price: Column, profile: Profile) -> Column:
    return _known((price > 0) & (price < profile.strong_deal_max_cents))


def is_discounted(price: Column, reference: Column, profile: Profile) -> Column:
    drop = (reference - price) * 100 / reference
    return F.when(reference > price, drop >= profile.min_discount_pct).otherwise(F.lit(False))


def is_deal(price: Column, struck: Column, previous: Column, profile: Profile) -> Column:
    """In the middle price band and discounted from the struck or the previous price."""
    band = (price >= profile.strong_deal_max_cents) & (price < profile.deal_max_cents)
    return _known(band) & (
        is_discounted(price, struck, profile) | is_discounted(price, previous, profile)
    )


def deal_label(price: Column, struck: Column, previous: Column, profile: Profile) -> Column:
    return F.when(is_strong_deal(price, profile), STRONG_DEAL).when(
        is_deal(price, struck, previous, profile), DEAL
    )


def junk_reason(price: Column, reason: Column, title: Column) -> Column:
    """Free is junk everywhere; bundle and episode forms only on theme shelves."""
    shelf = reason == "genre_category"
    return (
        F.when(price == 0, JUNK_FREE)
        .when(shelf & title.rlike(BUNDLE_PATTERN), JUNK_BUNDLE)
        .when(shelf & title.rlike(EPISODE_PATTERN), JUNK_EPISODE)
    )


def worth_announcing(
    price: Column,
    reason: Column,
    title: Column,
    availability: Column,
    profile: Profile,
    bundle: Column | None = None,
) -> Column:
    """Watchlist always, junk never, else borrowable, a saving bundle or a strong deal."""
    saving = F.lit(False) if bundle is None else _known(bundle)
    return (
        F.when(reason == "watchlist", True)
        .when(junk_reason(price, reason, title).isNotNull(), False)
        .otherwise(
            _known(availability == "available") | saving | is_strong_deal(price, profile)
        )
    )


def passes(stars: Column, threshold: int) -> Column:
    return stars >= threshold


def withholds(stars: Column, confidence: Column, threshold: int) -> Column:
    """A weak judgement may hide a find only if it is more than a guess."""
    return (stars < threshold) & (confidence != GUESSED)


def still_valid(origin: Column, version: Column, current: int) -> Column:
    return ~origin.isin(PROFILE_BOUND) | (version == current)
