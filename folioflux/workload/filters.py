"""Predicates over ratings, entries, runs and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.config import source_kind
from folioflux.functions import rules as R
from folioflux.operators import linkage, state
from folioflux.plans import gate, home, watchlist
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col
SQL_NOW = "TIMESTAMP '2001-08-01 03:00:00'"


def now():
    return F.lit("2001-08-01 03:00:00").cast("timestamp_ntz")


KIND = "CASE source WHEN 'view' THEN 'library' WHEN 'signup' THEN 'library' ELSE 'shop' END"


@query(
    "flt_08_restriction",
    f"""SELECT r.profile_slug, r.book_id, l.source,
  coalesce(json_extract_string(r.details, '$.restrict') = {KIND.replace('source', 'l.source', 1)}, TRUE) AS wanted
FROM relation r JOIN link l USING (book_id) WHERE r.kind = 'watching'""",
)
def _(t):
    rel = state.relations(t.relation_log).filter("kind = 'watching'")
    both = rel.join(state.links(t.link_log).select("book_id", "source"), "book_id")
    restriction = F.get_json_object("details", "$.restrict")
    return both.select(
        "profile_slug", "book_id", "source",
        watchlist.wants(restriction, c("source"), PROFILE).alias("wanted"),
    )


@query(
    "flt_10_gate_predicates",
    "SELECT seq, stars >= 3 AS passes, stars < 3 AND confidence <> 'vermutet' AS withholds FROM rating_log",
)
def _(t):
    return t.rating_log.select(
        "seq",
        R.passes(c("stars"), 3).alias("passes"),
        R.withholds(c("stars"), c("confidence"), 3).alias("withholds"),
    )


@query(
    "flt_11_valid_ratings",
    """SELECT subject, origin, seq FROM rating
WHERE origin NOT IN ('model', 'conversation') OR profile_version = 1""",
)
def _(t):
    return (
        state.ratings(t.rating_log)
        .filter(R.still_valid(c("origin"), c("profile_version"), 1))
        .select("subject", "origin", "seq")
    )


@query(
    "flt_12_entry_flags",
    "SELECT profile_slug, book_id, needs_attention, needs_choice, missing, unresolved FROM entry",
)
def _(t):
    return _entries(t).select(
        "profile_slug", "book_id", "needs_attention", "needs_choice", "missing", "unresolved"
    )


def _entries(t, include_paused: bool = True):
    return watchlist.entries(
        t.obs, t.book, state.links(t.link_log), state.relations(t.relation_log), PROFILE,
        include_paused,
    )


@query(
    "flt_13_retry_window",
    f"SELECT seq, url IS NOT NULL OR {SQL_NOW} - resolved_at < INTERVAL 7 DAY AS valid FROM link_log",
)
def _(t):
    return t.link_log.select(
        "seq", watchlist.link_still_valid(c("url"), c("resolved_at"), now()).alias("valid")
    )


@query(
    "flt_14_too_soon",
    f"""SELECT profile_slug, {SQL_NOW} - arg_max(started_at, run_id) < INTERVAL 20 HOUR AS too_soon
FROM run_log WHERE run_trigger <> 'entry' GROUP BY 1""",
)
def _(t):
    return home.too_soon(t.run_log, now(), 20)


_LAST = "CASE WHEN seq % 4 = 0 THEN NULL ELSE created_at END"


@query(
    "flt_15_sweep_due",
    f"""SELECT seq, coalesce(active AND ({_LAST} IS NULL OR {SQL_NOW} - {_LAST} >= INTERVAL 7 DAY
  OR (CAST({_LAST} AS DATE) < DATE '2001-08-01')), FALSE) AS due FROM relation_log""",
)
def _(t):
    last = F.when(c("seq") % 4 != 0, c("created_at"))
    # 2001-08-01 is a Wednesday: day 2 counted from Monday.
    return t.relation_log.select("seq", home.sweep_due(last, now(), 2, c("active")).alias("due"))


@query(
    "flt_16_abandoned_runs",
    f"""SELECT run_id, CASE WHEN finished_at IS NOT NULL THEN status
  WHEN {SQL_NOW} - started_at > INTERVAL 6 HOUR THEN 'abandoned' ELSE 'running' END AS status FROM run_log""",
)
def _(t):
    return t.run_log.select("run_id", home.journal_status(now()).alias("status"))


@query(
    "flt_17_authors_to_sweep",
    """SELECT profile_slug, value, CASE WHEN bool_or(tier = 'core') THEN 'core' ELSE 'extended' END AS tier
FROM (SELECT profile_slug, value, tier FROM interest_log WHERE interest_key = 'author' AND active)
GROUP BY 1, 2""",
)
def _(t):
    from folioflux.sources.collect import authors_to_sweep

    return authors_to_sweep(t.interest_log.filter("active"), include_extended=True)


@query(
    "flt_19_backlog_selection",
    """SELECT id FROM pile p WHERE status = 'shown' AND NOT EXISTS (
  SELECT 1 FROM rating r WHERE r.subject = p.subject AND r.origin = 'model' AND r.profile_version = 1)""",
)
def _(t):
    from folioflux.workload.views import pile_of

    shown = pile_of(t).filter("status = 'shown'")
    return gate.without_current_rating(shown, state.ratings(t.rating_log), 1).select("id")


@query(
    "flt_20_preferred_media",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag FROM (
  SELECT *, bool_or(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS has FROM lineitem)
WHERE NOT has OR l_returnflag = 'N'""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    return linkage.preferred(rows, ["l_orderkey"], c("l_returnflag") == "N")


@query(
    "src_15_registry",
    f"""SELECT source, {KIND} AS kind, CASE source WHEN 'click' THEN 'Klick-Laden' WHEN 'purchase' THEN 'Kauf-Laden'
  WHEN 'view' THEN 'Leih-Bibliothek' WHEN 'signup' THEN 'Stadtbibliothek' ELSE source END AS label, count(*) AS n
FROM obs GROUP BY source""",
)
def _(t):
    from folioflux.config import source_label

    return t.obs.groupBy("source").agg(F.count("*").alias("n")).select(
        "source", source_kind(PROFILE, c("source")).alias("kind"),
        source_label(PROFILE, c("source")).alias("label"), "n",
    )


@query(
    "win_10_previous_finished_run",
    """SELECT run_id, profile_slug, max(CASE WHEN finished_at IS NOT NULL AND run_trigger <> 'entry'
  THEN run_id END) OVER (PARTITION BY profile_slug ORDER BY run_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run FROM run_log""",
)
def _(t):
    return home.previous_finished(t.run_log).select("run_id", "profile_slug", "previous_run")


@query(
    "top_04_recent_runs",
    """SELECT profile_slug, run_id, status FROM run_log WHERE run_trigger <> 'entry'
QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY run_id DESC) <= 20""",
)
def _(t):
    return home.recent_runs(t.run_log).select("profile_slug", "run_id", "status")


@query(
    "top_06_sorted_listings",
    "SELECT book_id, title FROM book ORDER BY title, book_id",
)
def _(t):
    return t.book.select("book_id", "title").orderBy("title", "book_id")


@query(
    "top_06_active_interests",
    """SELECT interest_id, profile_slug, value FROM (
  SELECT profile_slug, interest_key, value, arg_max(active, seq) AS active, min(seq) AS interest_id
  FROM interest_log GROUP BY 1, 2, 3) WHERE active ORDER BY interest_id""",
)
def _(t):
    return (
        state.interests(t.interest_log).filter("active")
        .select("interest_id", "profile_slug", "value").orderBy("interest_id")
    )


@query(
    "fn_40_next_sweep",
    f"""SELECT seq, CASE WHEN {_LAST} IS NULL THEN 'next run'
  WHEN {_LAST} + INTERVAL 7 DAY <= {SQL_NOW} THEN 'overdue'
  ELSE strftime({_LAST} + INTERVAL 7 DAY, '%d.%m.%Y') END AS next FROM relation_log""",
)
def _(t):
    last = F.when(c("seq") % 4 != 0, c("created_at"))
    return t.relation_log.select("seq", home.next_sweep(last, now()).alias("next"))


@query(
    "agg_15_probe_failures",
    """SELECT source, arg_max(ok, seq) AS last_ok, max(probed_at) AS last_probe,
  count(*) FILTER (NOT ok AND seq > coalesce(last_good, -1)) AS failures
FROM probe_log LEFT JOIN (SELECT source, max(seq) AS last_good FROM probe_log WHERE ok GROUP BY 1) USING (source)
GROUP BY 1""",
)
def _(t):
    return state.probe_state(t.probe_log).select("source", "last_ok", "last_probe", "failures")


@query(
    "agg_16_source_health",
    """SELECT s.source, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'ok' ELSE 'failing' END AS health
FROM (SELECT DISTINCT source FROM link_log UNION SELECT DISTINCT source FROM switch_log) s
LEFT JOIN (SELECT source, arg_max(ok, seq) AS ok FROM probe_log GROUP BY 1) p USING (source)""",
)
def _(t):
    names = t.link_log.select("source").union(t.switch_log.select("source")).distinct()
    return home.source_health(names, state.probe_state(t.probe_log)).select("source", "health")


@query(
    "agg_16_last_complaints",
    """SELECT profile_slug, trim(unnest(string_split(error, ';'))) AS complaint FROM (
  SELECT profile_slug, error FROM run_log WHERE finished_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY run_id DESC) = 1) WHERE error IS NOT NULL""",
)
def _(t):
    return home.complaints(t.run_log)


@query(
    "agg_13_rating_distribution",
    "SELECT stars, count(*) AS n FROM rating WHERE origin = 'model' GROUP BY 1 ORDER BY 1 DESC",
)
def _(t):
    return (
        state.ratings(t.rating_log).filter("origin = 'model'")
        .groupBy("stars").agg(F.count("*").alias("n")).orderBy(c("stars").desc())
    )


@query(
    "agg_10_best_availability",
    "SELECT profile_slug, book_id, availability FROM entry",
)
def _(t):
    return _entries(t).select("profile_slug", "book_id", "availability")


@query("agg_11_newest_price", "SELECT profile_slug, book_id, price_cents, seen_at FROM entry")
def _(t):
    return _entries(t).select("profile_slug", "book_id", "price_cents", "seen_at")


@query(
    "agg_06_isbns_to_ask",
    """SELECT profile_slug, isbn, last_seen FROM (
  SELECT profile_slug, isbn, max(id) AS last_seen FROM obs o WHERE isbn IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM single_price s WHERE s.price_cents % 300 = 0
      AND o.isbn = '978' || lpad(CAST(s.contained AS varchar), 10, '0')) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY last_seen DESC) <= 50""",
)
def _(t):
    from folioflux.sources.records import isbns_to_ask

    asked = t.single_price.filter("price_cents % 300 = 0").select(
        F.concat(F.lit("978"), F.lpad(c("contained").cast("string"), 10, "0")).alias("isbn")
    )
    return isbns_to_ask(t.obs, asked, PROFILE.record_budget).select(
        "profile_slug", "isbn", "last_seen"
    )


@query(
    "set_01_union_of_sources",
    "SELECT source, count(*) AS n FROM (SELECT source FROM obs UNION ALL SELECT source FROM link_log) GROUP BY 1",
)
def _(t):
    from folioflux.sources.validation import union_all

    both = union_all([t.obs.select("source"), t.link_log.select("source", "book_id")])
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query(
    "set_02_difference",
    "SELECT DISTINCT isbn FROM obs WHERE isbn IS NOT NULL AND isbn NOT IN (SELECT isbn FROM book WHERE isbn IS NOT NULL)",
)
def _(t):
    return (
        t.obs.select("isbn").filter("isbn is not null").distinct()
        .join(t.book.select("isbn"), "isbn", "left_anti")
    )
