"""Ranked piles, entry lists and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue as C
from folioflux.operators import lookups, ordered, state
from folioflux.operators.changes import ITEM
from folioflux.plans import home, pages
from folioflux.plans import pile as piles
from folioflux.plans import watchlist
from folioflux.workload import sqltext as S
from folioflux.workload.filters import SQL_NOW, _entries, now
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col


def pile_of(t, reason: str | None = None) -> DataFrame:
    return piles.classified(
        t.obs, t.book, state.links(t.link_log), state.relations(t.relation_log),
        state.ratings(t.rating_log), t.contains, PROFILE, reason,
    )


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in piles.STATUSES)


@query("q_01_suggestion_pile", f"""SELECT id, stars, nullif(pitch, '') AS pitch, saved_pct,
  coalesce(price_cents > 0 AND price_cents < 500, FALSE) AS deal, {S.money('price_cents')} AS price
FROM pile WHERE status = 'shown'""")
def _(t):
    return piles.suggestions(pile_of(t), PROFILE).select(
        "id", "stars", "pitch", "saved_pct", "deal", "price"
    )


@query("agg_09_pile_counters", f"SELECT profile_slug, {_COUNTS} FROM pile GROUP BY 1")
def _(t):
    return piles.counters(pile_of(t))


@query(
    "q_01_pile_for_one_reason",
    f"SELECT profile_slug, {_COUNTS} FROM pile WHERE status <> 'shown' OR match_reason = 'profile_author' GROUP BY 1",
)
def _(t):
    return piles.counters(pile_of(t, "profile_author"))


@query(
    "top_02_best_suggestions",
    """SELECT profile_slug, id, CAST(row_number() OVER (PARTITION BY profile_slug
  ORDER BY stars IS NULL, stars DESC, id DESC) AS INT) AS rank FROM pile WHERE status = 'shown'
QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY stars IS NULL, stars DESC, id DESC) <= 10""",
)
def _(t):
    rows = piles.suggestions(pile_of(t), PROFILE)
    return ordered.top_per_key(
        rows, ["profile_slug"], piles.best_first(), PROFILE.page_size
    ).select("profile_slug", "id", "rank")


_ENTRY = "profile_slug, book_id, title, active, needs_attention, needs_choice, missing, availability, price_cents, deal"


@query("q_02_watchlist_view", f"SELECT {_ENTRY} FROM entry")
def _(t):
    return _entries(t).select(*_ENTRY.split(", ")).orderBy(*watchlist.reading_order())


@query(
    "top_01_watchlist_order",
    """SELECT profile_slug, book_id, row_number() OVER (PARTITION BY profile_slug
  ORDER BY needs_attention DESC, lower(title), book_id) AS place FROM entry""",
)
def _(t):
    rows = _entries(t).select(
        "profile_slug", "book_id", c("needs_attention").cast("int").alias("attention"),
        F.lower("title").alias("sort_title"),
    )
    placed = ordered.position(
        rows, ["profile_slug"], "book_id", "place",
        coarse=[("attention", True), ("sort_title", False)],
    )
    return placed.select("profile_slug", "book_id", "place")


@query(
    "top_03_offers",
    """SELECT profile_slug, book_id, CAST(row_number() OVER w AS INT) AS rank FROM entry
WHERE active AND (deal OR borrowable)
WINDOW w AS (PARTITION BY profile_slug ORDER BY deal DESC, CASE WHEN deal THEN price_cents ELSE 0 END,
  lower(title), needs_attention DESC, book_id) QUALIFY row_number() OVER w <= 5""",
)
def _(t):
    return home.offers(_entries(t), PROFILE).select("profile_slug", "book_id", "rank")


@query(
    "q_03_home_view",
    f"""SELECT profile_slug, coalesce(w.n, 0) AS watchlist_total, coalesce(w.offers, 0) AS offers_total,
  coalesce(p.n, 0) AS suggestions_total, s.age_days, s.age_days >= 1 AS stale, s.failed
FROM (SELECT profile_slug, count(*) AS n, count(*) FILTER (deal OR borrowable) AS offers FROM entry WHERE active GROUP BY 1) w
FULL JOIN (SELECT profile_slug, count(*) FILTER (status = 'shown') AS n FROM pile GROUP BY 1) p USING (profile_slug)
LEFT JOIN (SELECT profile_slug, CAST(floor(epoch({SQL_NOW} - arg_max(finished_at, run_id)) / 86400) AS BIGINT) AS age_days,
    arg_max(coalesce(error, '-'), run_id) <> '-' AS failed
  FROM (SELECT * FROM run_log WHERE run_trigger <> 'entry'
    QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY run_id DESC) <= 5)
  WHERE finished_at IS NOT NULL GROUP BY 1) s USING (profile_slug)""",
)
def _(t):
    return home.summary(_entries(t), pile_of(t), t.run_log, now()).select(
        "profile_slug", "watchlist_total", "offers_total", "suggestions_total",
        "age_days", "stale", "failed",
    )


@query(
    "agg_18_run_status",
    f"""SELECT profile_slug, CAST(floor(epoch({SQL_NOW} - arg_max(finished_at, run_id)) / 86400) AS BIGINT) AS age_days,
  arg_max(delta_count, run_id) AS delta_count
FROM (SELECT * FROM run_log WHERE run_trigger <> 'entry'
  QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY run_id DESC) <= 5)
WHERE finished_at IS NOT NULL GROUP BY 1""",
)
def _(t):
    return home.last_status(t.run_log, now()).select("profile_slug", "age_days", "delta_count")


@query(
    "q_04_book_pages",
    """SELECT profile_slug, book_id, id, rank, hidden, deal FROM (
  SELECT profile_slug, book_id, id, CAST(row_number() OVER w AS INT) AS rank,
    greatest(count(*) OVER (PARTITION BY profile_slug, book_id) - 5, 0) AS hidden,
    coalesce(price_cents > 0 AND price_cents < 500, FALSE) AS deal
  FROM (SELECT profile_slug, book_id, id, price_cents FROM (
    SELECT *, row_number() OVER (PARTITION BY profile_slug, book_id ORDER BY id DESC) AS rn FROM (
      SELECT profile_slug, book_id, id, price_cents FROM obs WHERE book_id IS NOT NULL
      UNION
      SELECT o.profile_slug, l.book_id, o.id, o.price_cents FROM obs o JOIN link l
        ON o.source = l.source AND o.source_item_id = l.source_item_id)) WHERE rn <= 200)
  WINDOW w AS (PARTITION BY profile_slug, book_id ORDER BY id DESC)) WHERE rank <= 5""",
)
def _(t):
    from folioflux.functions import rules

    log = t.obs.select(*ITEM, "book_id", "id", "price_cents")
    history = lookups.history_of_books(log, state.links(t.link_log)).drop("rank", "book_id")
    recent = pages.recent_history(history, ["profile_slug", "history_of"])
    return recent.select(
        "profile_slug", c("history_of").alias("book_id"), "id", "rank", "hidden",
        rules.is_strong_deal(c("price_cents"), PROFILE).alias("deal"),
    )


@query(
    "q_05_find_pages",
    f"""SELECT o.id, o.title, {S.THEME} AS theme, d.book_id IS NOT NULL AS answered_by_book
FROM obs_latest o LEFT JOIN (
  SELECT DISTINCT l.source, l.source_item_id, r.profile_slug, min(l.book_id) OVER (
    PARTITION BY l.source, l.source_item_id, r.profile_slug) AS book_id
  FROM link l JOIN relation r USING (book_id) WHERE r.active AND l.source_item_id IS NOT NULL) d
ON d.source = o.source AND d.source_item_id = o.source_item_id AND d.profile_slug = o.profile_slug""",
)
def _(t):
    newest = ordered.latest(t.obs.select(*ITEM, "id", "title", "category"), ITEM)
    decided = lookups.decided_items(
        state.links(t.link_log), state.relations(t.relation_log)
    ).withColumn("answered_by_book", F.lit(True))
    return newest.join(decided, ITEM, "left").select(
        "id", "title", C.theme_name(c("category")).alias("theme"),
        F.coalesce("answered_by_book", F.lit(False)).alias("answered_by_book"),
    )


@query(
    "q_06_profile_shelves",
    """SELECT r.profile_slug, r.kind, b.book_id, b.title FROM relation r JOIN book b USING (book_id) WHERE r.active""",
)
def _(t):
    return home.shelves(state.relations(t.relation_log), t.book).orderBy("place", "title").select(
        "profile_slug", "kind", "book_id", "title"
    )


@query(
    "agg_14_shelf_counts",
    "SELECT profile_slug, kind, count(*) AS books FROM relation WHERE active GROUP BY 1, 2",
)
def _(t):
    return home.shelf_counts(state.relations(t.relation_log))
