"""Settings of a profile and the registry of its sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

LIBRARY = "library"
SHOP = "shop"


@dataclass(frozen=True)
class Profile:
    """Thresholds of one profile. Money is in integer cents."""

    slug: str = "p0"
    name: str = "default"
    strong_deal_max_cents: int = 500
    deal_max_cents: int = 1000
    min_discount_pct: int = 25
    rating_threshold: int = 3
    rating_budget: int = 40
    record_budget: int = 50
    batch_size: int = 20
    home_offers: int = 5
    home_suggestions: int = 3
    page_size: int = 10
    run_every_hours: int = 20
    sweep_weekday: int = 6
    profile_version: int = 1
    #: name -> (kind, label), in the order in which shops are asked.
    sources: dict[str, tuple[str, str]] = field(default_factory=dict)

    def shops(self) -> list[str]:
        return [name for name, (kind, _) in self.sources.items() if kind == SHOP]


def source_kind(profile: Profile, source: Column) -> Column:
    """library or shop; a source nobody configured counts as a shop."""
    # The registry is configuration of a few names, so it is a literal map in
    # the expression and needs no join.
    return _lookup({n: k for n, (k, _) in profile.sources.items()}, source, F.lit(SHOP))


def source_label(profile: Profile, source: Column) -> Column:
    return _lookup({n: t for n, (_, t) in profile.sources.items()}, source, source)


def _lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    if not values:
        return default
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[key], default)


def label_map(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Label of a stored value; unknown values stay as they are."""
    return _lookup(values, key, key if default is None else default)
