"""Latest state, change feed, prices and history over the observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue as C
from folioflux.functions import rules as R
from folioflux.functions import text as T
from folioflux.operators import bundles, changes, lookups
from folioflux.operators.changes import ITEM
from folioflux.workload import sqltext as S
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col


def _feed_sql(announce: str, columns: str = "id, kind, prev_id, position") -> str:
    """All changes of every row; ``position`` counts the changes of one row."""
    return f"""
SELECT {columns} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY part) - 1 AS INT) AS position FROM (
    SELECT *, 0 AS part, 'first_seen' AS kind FROM obs_prev o WHERE prev_id IS NULL AND {announce}
    UNION ALL
    SELECT *, 1, CASE WHEN availability = 'available' THEN 'became_available' ELSE 'became_unavailable' END
    FROM obs_prev o WHERE availability <> prev_av AND 'available' IN (availability, prev_av)
    UNION ALL
    SELECT *, 2, CASE WHEN price_cents < prev_price THEN 'price_drop' ELSE 'price_rise' END
    FROM obs_prev o WHERE price_cents > prev_price OR (price_cents < prev_price AND {announce})))"""


def compared(t) -> DataFrame:
    return changes.with_previous(t.obs)


@query("agg_01_change_feed", _feed_sql(S.announce()))
def _(t):
    return changes.changes(compared(t), PROFILE).select(
        "id", "kind", c("previous.id").alias("prev_id"), "position"
    )


@query(
    "agg_01_change_feed_with_bundles",
    _feed_sql(S.announce("EXISTS (SELECT 1 FROM advantages a WHERE a.id = o.id)"), "id, kind"),
)
def _(t):
    found = with_advantage(t, compared(t))
    return changes.changes(found, PROFILE, c("advantage").isNotNull()).select("id", "kind")


def with_advantage(t, finds: DataFrame) -> DataFrame:
    return bundles.with_advantage(
        finds,
        bundles.last_prices(t.obs, "title"),
        bundles.last_prices(t.obs, "isbn"),
        t.contains,
        PROFILE,
        keys_from=t.obs,
    )


@query(
    "flt_07_notifiable",
    f"SELECT id, kind FROM ({_feed_sql(S.announce(), 'id, kind')}) "
    "WHERE kind IN ('first_seen', 'became_available', 'price_drop')",
)
def _(t):
    return changes.notifiable(changes.changes(compared(t), PROFILE)).select("id", "kind")


@query(
    "win_01_state_before_run",
    "SELECT id, prev_id, prev_price, prev_av AS prev_availability FROM obs_prev",
)
def _(t):
    return compared(t).select(
        "id",
        c("previous.id").alias("prev_id"),
        c("previous.price_cents").alias("prev_price"),
        c("previous.availability").alias("prev_availability"),
    )


@query(
    "flt_01_strong_deal",
    "SELECT id, coalesce(price_cents > 0 AND price_cents < 500, FALSE) AS strong FROM obs",
)
def _(t):
    return t.obs.select("id", R.is_strong_deal(c("price_cents"), PROFILE).alias("strong"))


@query(
    "flt_02_discount",
    """SELECT id, coalesce(original_price_cents > price_cents
  AND (original_price_cents - price_cents) * 100.0 / original_price_cents >= 25, FALSE) AS discounted FROM obs""",
)
def _(t):
    return t.obs.select(
        "id",
        R.is_discounted(c("price_cents"), c("original_price_cents"), PROFILE).alias("discounted"),
    )


_DEAL = """coalesce(price_cents >= 500 AND price_cents < 1000, FALSE) AND (
  coalesce(original_price_cents > price_cents
    AND (original_price_cents - price_cents) * 100.0 / original_price_cents >= 25, FALSE)
  OR coalesce(prev_price > price_cents AND (prev_price - price_cents) * 100.0 / prev_price >= 25, FALSE))"""


@query("flt_03_deal", f"SELECT id, {_DEAL} AS deal FROM obs_prev")
def _(t):
    return compared(t).select(
        "id",
        R.is_deal(
            c("price_cents"), c("original_price_cents"), c("previous.price_cents"), PROFILE
        ).alias("deal"),
    )


_LABEL = f"CASE WHEN price_cents > 0 AND price_cents < 500 THEN 'Strong Deal' WHEN {_DEAL} THEN 'Deal' END"


@query("flt_04_deal_label", f"SELECT id, {_LABEL} AS label FROM obs_prev")
def _(t):
    return compared(t).select(
        "id",
        R.deal_label(
            c("price_cents"), c("original_price_cents"), c("previous.price_cents"), PROFILE
        ).alias("label"),
    )


@query("flt_05_junk", f"SELECT id, {S.junk()} AS junk FROM obs")
def _(t):
    return t.obs.select(
        "id", R.junk_reason(c("price_cents"), c("match_reason"), c("title")).alias("junk")
    )


@query("flt_06_worth_announcing", f"SELECT id, {S.announce()} AS announce FROM obs")
def _(t):
    return t.obs.select(
        "id",
        R.worth_announcing(
            c("price_cents"), c("match_reason"), c("title"), c("availability"), PROFILE
        ).alias("announce"),
    )


@query(
    "src_01_observation_scan",
    "SELECT id, source, source_item_id, price_cents, availability FROM obs WHERE profile_slug = 'p0'",
)
def _(t):
    return t.obs.filter("profile_slug = 'p0'").select(
        "id", "source", "source_item_id", "price_cents", "availability"
    )


@query(
    "join_01_latest_for_keys",
    """SELECT k.profile_slug, k.source, k.source_item_id, l.id, l.price_cents
FROM (SELECT DISTINCT profile_slug, source, cast(book_id AS varchar) AS source_item_id
      FROM relation_log CROSS JOIN (SELECT DISTINCT source FROM obs) s) k
LEFT JOIN obs_latest l USING (profile_slug, source, source_item_id)""",
)
def _(t):
    sources = F.array(*[F.lit(s) for s in ("click", "purchase", "view", "signup", "error")])
    keys = t.relation_log.select(
        "profile_slug", F.explode(sources).alias("source"),
        c("book_id").cast("string").alias("source_item_id"),
    ).distinct()
    return lookups.latest_for_keys(
        t.obs.select(*ITEM, "id", "price_cents"), keys
    ).select(*ITEM, "id", "price_cents")


@query(
    "join_03_item_history",
    f"""SELECT {S.ITEM}, id, CAST(row_number() OVER (PARTITION BY {S.ITEM} ORDER BY id DESC) AS INT) AS rank
FROM obs QUALIFY row_number() OVER (PARTITION BY {S.ITEM} ORDER BY id DESC) <= 200""",
)
def _(t):
    return lookups.history_of_items(t.obs.select(*ITEM, "id"))


_HISTORY = """
SELECT profile_slug, history_of, id, rank FROM (
  SELECT profile_slug, history_of, id,
    CAST(row_number() OVER (PARTITION BY profile_slug, history_of ORDER BY id DESC) AS INT) AS rank
  FROM (SELECT profile_slug, book_id AS history_of, id FROM obs WHERE book_id IS NOT NULL
        UNION
        SELECT o.profile_slug, l.book_id, o.id FROM obs o JOIN (
          SELECT book_id, source, source_item_id, seq FROM link_log
          QUALIFY row_number() OVER (PARTITION BY book_id, source ORDER BY seq DESC) = 1) l
        ON o.source = l.source AND o.source_item_id = l.source_item_id))
WHERE rank <= 200"""


@query("join_02_book_history", _HISTORY)
def _(t):
    from folioflux.operators import state

    return lookups.history_of_books(
        t.obs.select("profile_slug", "source", "source_item_id", "book_id", "id"),
        state.links(t.link_log),
    ).select("profile_slug", "history_of", "id", "rank")


@query(
    "agg_02_latest_by_book",
    """SELECT profile_slug, book_id, source, max(id) AS id, arg_max(title, id) AS title
FROM obs WHERE book_id IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    log = t.obs.select("profile_slug", "book_id", "source", "id", "title")
    return lookups.latest_by_book(log)


@query(
    "agg_03_latest_discoveries",
    f"SELECT {S.ITEM}, id, title, price_cents, match_reason FROM finds",
)
def _(t):
    return lookups.latest_discoveries(
        t.obs.select(*ITEM, "id", "title", "price_cents", "match_reason")
    )


@query("agg_04_title_prices", "SELECT * FROM title_price")
def _(t):
    return bundles.last_prices(t.obs, "title")


@query("agg_05_isbn_prices", "SELECT * FROM isbn_price")
def _(t):
    return bundles.last_prices(t.obs, "isbn")


@query(
    "agg_07_bundle_savings",
    """SELECT bundle_id, price_cents, singles_cents, volumes, singles_cents - price_cents AS saved_cents, saved_pct
FROM (SELECT b.bundle_id, b.price_cents, sum(s.price_cents) AS singles_cents, count(*) AS volumes,
  CAST(round_even((sum(s.price_cents) - b.price_cents) * 100.0 / sum(s.price_cents), 0) AS INT) AS saved_pct,
  count(s.price_cents) AS priced
  FROM bundle b JOIN bundle_volume v USING (bundle_id) LEFT JOIN single_price s ON s.contained = v.contained
  GROUP BY 1, 2)
WHERE priced = volumes AND volumes >= 2 AND price_cents > 0 AND singles_cents > price_cents AND saved_pct >= 25""",
)
def _(t):
    return bundles.savings(t.bundle, t.bundle_volume, t.single_price, 25)


@query("join_12_bundle_advantage", "SELECT * FROM advantages")
def _(t):
    return (
        with_advantage(t, t.obs)
        .filter("advantage is not null")
        .select("id", "advantage.*")
    )


@query(
    "join_13_advantage_per_find",
    "SELECT f.id, a.shop, a.saved_pct FROM finds f LEFT JOIN advantages a ON a.id = f.id",
)
def _(t):
    found = with_advantage(t, lookups.latest_discoveries(t.obs))
    return found.select("id", "advantage.shop", "advantage.saved_pct")


@query(
    "udf_01_own_shop_advantage",
    """SELECT id FROM (
  SELECT m.id, z.volumes, f.price_cents, sum(p.price_cents) AS singles, count(*) AS priced
  FROM bundle_members m JOIN bundle_sizes z ON z.id = m.id AND z.route = m.route
  JOIN obs f ON f.id = m.id
  JOIN (SELECT 'isbn' AS route, profile_slug, source, isbn AS volume, price_cents FROM isbn_price
        UNION ALL SELECT 'title', profile_slug, source, title, price_cents FROM title_price) p
    ON p.route = m.route AND p.volume = m.volume AND p.profile_slug = m.profile_slug AND p.source = f.source
  WHERE p.source IN ('click', 'purchase') AND m.route = CASE WHEN EXISTS (
      SELECT 1 FROM bundle_sizes y WHERE y.id = m.id AND y.route = 'isbn' AND y.volumes >= 2)
    THEN 'isbn' ELSE 'title' END
  GROUP BY 1, 2, 3)
WHERE priced = volumes AND singles > price_cents
  AND round_even((singles - price_cents) * 100.0 / singles, 0) >= 25""",
)
def _(t):
    return (
        bundles.with_advantage(
            t.obs,
            bundles.last_prices(t.obs, "title"),
            bundles.last_prices(t.obs, "isbn"),
            t.contains,
            PROFILE,
            same_shop=True,
        )
        .filter("advantage is not null")
        .select("id")
    )


@query(
    "join_14_contained_isbns",
    "SELECT o.id, e.contained FROM finds o JOIN contains e ON e.isbn = o.isbn",
)
def _(t):
    return lookups.latest_discoveries(t.obs.select(*ITEM, "id", "isbn", "match_reason")).join(
        t.contains, "isbn"
    ).select("id", "contained")


@query(
    "win_02_price_points",
    f"""SELECT {S.ITEM}, id, price_cents FROM obs WHERE price_cents IS NOT NULL
QUALIFY lag(price_cents) OVER (PARTITION BY {S.ITEM} ORDER BY id) IS DISTINCT FROM price_cents""",
)
def _(t):
    from folioflux.plans.pages import price_points

    # Narrow first: the ranges are written, and what is written is not pruned later.
    return price_points(t.obs.select(*ITEM, "id", "price_cents"), ITEM)


@query(
    "win_03_newest_per_source",
    """SELECT profile_slug, book_id, source, id FROM obs WHERE book_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY profile_slug, book_id, source
  ORDER BY observed_at DESC NULLS LAST, id DESC) = 1""",
)
def _(t):
    log = t.obs.filter("book_id is not null").select(
        "profile_slug", "book_id", "source", "id", "observed_at"
    )
    # NULL timestamps sort before all others, so max_by takes them last.
    newest = log.groupBy("profile_slug", "book_id", "source").agg(
        F.max_by("id", F.struct("observed_at", "id")).alias("id")
    )
    return newest


@query(
    "win_04_origin",
    f"""SELECT {S.ITEM}, arg_max(match_reason, id) AS reason, max(id) AS id
FROM obs WHERE match_reason <> 'watchlist' GROUP BY ALL""",
)
def _(t):
    from folioflux.plans.pages import origin_of

    return origin_of(t.obs, ITEM).select(*ITEM, "reason", "id")


@query(
    "win_05_other_title",
    """SELECT o.id, CASE WHEN trim(o.title) <> trim(l.title) THEN o.title END AS other_title
FROM obs o JOIN obs_latest l USING (profile_slug, source, source_item_id)""",
)
def _(t):
    from folioflux.plans.pages import with_other_title

    return with_other_title(t.obs.select(*ITEM, "id", "title"), ITEM).select("id", "other_title")


@query(
    "win_06_recent_history",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY {S.ITEM} ORDER BY id DESC) AS INT) AS rank,
  greatest(count(*) OVER (PARTITION BY {S.ITEM}) - 5, 0) AS hidden
FROM obs QUALIFY row_number() OVER (PARTITION BY {S.ITEM} ORDER BY id DESC) <= 5""",
)
def _(t):
    from folioflux.plans.pages import recent_history

    return recent_history(t.obs.select(*ITEM, "id"), ITEM).select("id", "rank", "hidden")


@query("flt_09_truncated", "SELECT id, coalesce(regexp_matches(blurb, '(\\.\\.\\.|…)\\s*$'), FALSE) AS cut FROM obs")
def _(t):
    return t.obs.select("id", C.is_truncated(c("blurb")).alias("cut"))


@query(
    "flt_18_title_mismatch",
    """SELECT l.seq, b.book_id, len(a) > 0 AND len(m) > 0 AND NOT list_has_any(a, m) AS mismatch FROM (
  SELECT l.seq, l.book_id, list_filter(string_split(lower(b.title), ' '), lambda w: length(w) > 3) AS a,
   list_filter(string_split(lower(l.matched_title), ' '), lambda w: length(w) > 3) AS m
  FROM link_log l JOIN book b USING (book_id) WHERE matched_title IS NOT NULL) l JOIN book b USING (book_id)""",
)
def _(t):
    both = t.link_log.filter("matched_title is not null").join(t.book, "book_id")
    return both.select(
        "seq", "book_id", T.titles_mismatch(c("title"), c("matched_title")).alias("mismatch")
    )



@query(
    "set_03_distinct_scopes",
    "SELECT DISTINCT profile_slug, source, match_reason, coalesce(category, '') AS category FROM obs WHERE match_reason <> 'watchlist'",
)
def _(t):
    return (
        t.obs.filter("match_reason <> 'watchlist'")
        .select("profile_slug", "source", "match_reason", F.coalesce("category", F.lit("")).alias("category"))
        .distinct()
    )


@query(
    "agg_12_preferred_spelling",
    """SELECT full_name, arg_min(author, (contains(author, ','), -marks, -length(author), author)) AS author FROM (
  SELECT DISTINCT full_name, author,
    length(author) - length(regexp_replace(author, '[äöüéø]', '', 'g')) AS marks FROM author_norm)
GROUP BY full_name""",
)
def _(t):
    from folioflux.operators.linkage import preferred_spelling

    names = t.obs.select("author").unionByName(t.book.select("author")).filter(
        "author is not null"
    )
    return preferred_spelling(names, T.author_key(c("author")).alias("full_name"))
