"""Gate, backlog, seed, run, enrichment and repair over the catalogue tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue as C
from folioflux.operators import changes, lookups, ordered, state
from folioflux.operators.changes import ITEM
from folioflux.plans import decide, gate, jobs, watchlist
from folioflux.plans import pile as piles
from folioflux.session import materialize, shared_folder
from folioflux.sources import collect, records, sinks
from folioflux.workload import sqltext as S
from folioflux.workload.changes import compared
from folioflux.workload.filters import SQL_NOW, _entries, now
from folioflux.workload.ingest import _DIGEST, attention_of, failures_of, search_hits
from folioflux.workload.lookups import _JUDGED
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE
from folioflux.workload.views import pile_of

c = F.col
RUN = ["profile_slug", "run_id"]


def _rate(finds: DataFrame) -> DataFrame:
    """Stands for a model: ratings by the find's number, every seventh unanswered."""
    return finds.filter("id % 7 <> 0").select(
        "id", (c("id") % 6).cast("double").alias("stars"),
        F.when(c("id") % 3 == 0, "vermutet").otherwise("belegt").alias("confidence"),
        F.concat(F.lit("Grund "), "id").alias("reason"), F.lit("").alias("pitch"),
    )


def _deltas(t) -> DataFrame:
    return changes.notifiable(changes.changes(compared(t), PROFILE))


_GATE = f"""SELECT d.*, j.seq AS rated, CASE
  WHEN d.match_reason = 'watchlist' THEN 'kept'
  WHEN u.stars < 3 AND u.confidence <> 'vermutet' THEN 'held_back'
  WHEN u.stars < 3 THEN 'shown_unsure'
  WHEN j.seq IS NOT NULL THEN 'reused'
  WHEN d.kind <> 'first_seen' THEN 'kept'
  WHEN a.id IS NULL THEN 'over_budget'
  WHEN d.id % 7 = 0 THEN 'unrated' ELSE 'rated' END AS decision,
  j.seq IS NULL AND d.kind = 'first_seen' AND a.id IS NOT NULL AND d.id % 7 <> 0 AND d.match_reason <> 'watchlist' AS fresh
FROM delta d
JOIN (SELECT j.*, r.confidence FROM ({_JUDGED}) j LEFT JOIN rating r ON r.seq = j.seq) j USING (id)
LEFT JOIN (SELECT id FROM (SELECT d.id, row_number() OVER (PARTITION BY d.profile_slug, d.run_id ORDER BY d.id) AS n
    FROM delta d JOIN ({_JUDGED}) j USING (id)
    WHERE d.kind = 'first_seen' AND d.match_reason <> 'watchlist' AND j.seq IS NULL) WHERE n <= 40) a ON a.id = d.id
LEFT JOIN LATERAL (SELECT CASE WHEN j.seq IS NOT NULL THEN j.stars
    WHEN d.kind = 'first_seen' AND a.id IS NOT NULL AND d.id % 7 <> 0 THEN d.id % 6 END AS stars,
  CASE WHEN j.seq IS NOT NULL THEN j.confidence WHEN d.id % 3 = 0 THEN 'vermutet' ELSE 'belegt' END AS confidence) u ON TRUE"""


def _decided(t) -> DataFrame:
    return gate.apply(_deltas(t), state.ratings(t.rating_log), PROFILE, RUN, _rate)


@query("q_07_gate_decisions", f"SELECT id, kind, decision FROM ({_GATE})")
def _(t):
    return _decided(t).select("id", "kind", "decision")


@query(
    "agg_08_gate_counters",
    f"""SELECT profile_slug, run_id, count(*) FILTER (decision = 'held_back') AS held_back,
  count(*) FILTER (fresh) AS rated, count(*) FILTER (rated IS NOT NULL AND match_reason <> 'watchlist') AS reused,
  count(*) FILTER (decision = 'unrated') AS unrated, count(*) FILTER (decision = 'over_budget') AS over_budget,
  count(*) FILTER (decision = 'shown_unsure') AS shown_unsure FROM ({_GATE}) GROUP BY 1, 2""",
)
def _(t):
    return gate.report(_decided(t), RUN)


@query(
    "udf_02_gate_with_full_blurbs",
    f"SELECT decision, count(*) AS n FROM ({_GATE}) GROUP BY 1",
)
def _(t):
    details = t.documents.select(
        c("doc_id").cast("string").alias("source_item_id"), c("text").alias("detail_blurb"),
        F.lit(None).cast("string").alias("detail_cover"),
    )
    decided = gate.apply(
        _deltas(t), state.ratings(t.rating_log), PROFILE, RUN, _rate,
        lambda finds: jobs.fill_blurbs(finds, details, ["source_item_id"]),
    )
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


_BACKLOG = """SELECT p.*, row_number() OVER (PARTITION BY profile_slug ORDER BY id) AS rn FROM pile p
WHERE status = 'shown' AND NOT EXISTS (SELECT 1 FROM rating r WHERE r.subject = p.subject
  AND r.origin = 'model' AND r.profile_version = 1)"""


def _backlog(t) -> DataFrame:
    shown = piles.suggestions(pile_of(t), PROFILE)
    open_ = gate.without_current_rating(shown, state.ratings(t.rating_log), 1)
    return gate.batches(open_, PROFILE.batch_size, ["profile_slug"])


@query(
    "q_08_backlog_batches",
    f"SELECT id, CAST((rn - 1) // 20 AS BIGINT) AS batch, CAST((rn - 1) % 20 + 1 AS INT) AS number FROM ({_BACKLOG})",
)
def _(t):
    return _backlog(t).select("id", "batch", "number")


@query(
    "fn_37_batch_prompts",
    f"""SELECT profile_slug, CAST((rn - 1) // 20 AS BIGINT) AS batch, count(*) AS books,
  md5(string_agg('--- BUCH ' || ((rn - 1) % 20 + 1) || ' ---' || chr(10) || concat_ws(chr(10), 'Titel: ' || title,
    'Untertitel: ' || subtitle, 'Autor:in: ' || coalesce(author, 'unbekannt'), 'Reihe: ' || series,
    'Thema: ' || {S.THEME}, 'Preis: ' || printf('%.2f EUR', price_cents / 100.0),
    'Klappentext' || CASE WHEN regexp_matches(blurb, '(\\.\\.\\.|…)\\s*$')
      THEN ' (von der Quelle abgeschnitten)' ELSE '' END || ': ' || blurb), chr(10) || chr(10) ORDER BY rn)) AS prompt
FROM ({_BACKLOG}) GROUP BY 1, 2""",
)
def _(t):
    prompts = gate.batch_prompts(_backlog(t), ["profile_slug"])
    return prompts.select("profile_slug", "batch", "books", F.md5("prompt").alias("prompt"))


def _answers(batched: DataFrame) -> DataFrame:
    """Answers to the batches: some entries wrong, some texts with a stray escape."""
    number = c("number").cast("string")
    entry = F.concat(
        F.lit('"'), number, F.lit('": {"stars": '),
        F.when(c("id") % 5 == 0, F.lit('"neun"')).otherwise((c("id") % 6).cast("string")),
        F.lit(', "confidence": "'), F.when(c("id") % 7 == 0, "sicher").otherwise(" Belegt "),
        F.lit('", "reason": "'), F.when(c("id") % 11 == 0, " ").otherwise("Max\\'s Grund"), F.lit('"}'),
    )
    return batched.groupBy("profile_slug", "batch").agg(
        F.concat(F.lit("Hier: {"), F.array_join(F.collect_list(entry), ", "), F.lit("} Ende")).alias("answer")
    )


_PARSED = """SELECT id, CASE WHEN id % 5 = 0 THEN 'stars' WHEN id % 7 = 0 THEN 'confidence'
  WHEN id % 11 = 0 THEN 'reason' END AS problem FROM finds"""


@query(
    "fn_38_parsed_answers",
    f"SELECT id, CAST(id % 6 AS INT) AS stars, 'belegt' AS confidence, 'Max''s Grund' AS answer_reason FROM ({_PARSED}) WHERE problem IS NULL",
)
def _(t):
    batched = _finds_in_batches(t)
    good, _ = gate.parse_answers(_answers(batched), batched, ["profile_slug"], ["belegt", "teils", "vermutet"])
    return good.select("id", "stars", "confidence", "answer_reason")


def _finds_in_batches(t) -> DataFrame:
    finds = lookups.latest_discoveries(t.obs.select(*ITEM, "id", "match_reason"))
    return gate.batches(finds, 20, ["profile_slug"])


@query("fn_38_rejected_answers", f"SELECT id, problem FROM ({_PARSED}) WHERE problem IS NOT NULL")
def _(t):
    batched = _finds_in_batches(t)
    _, bad = gate.parse_answers(_answers(batched), batched, ["profile_slug"], ["belegt", "teils", "vermutet"])
    return bad.select("id", "problem")


@query(
    "udf_03_rater_over_batches",
    "SELECT id, CAST(length(title) % 6 AS INT) AS stars FROM finds",
)
def _(t):
    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "stars": batch["title"].str.len() % 6})

    finds = lookups.latest_discoveries(t.obs.select(*ITEM, "id", "title", "match_reason"))
    return finds.select("id", "title").mapInPandas(rate, "id long, stars int")


@query(
    "udf_04_registered_source",
    "SELECT source, count(*) AS n FROM (SELECT 'tabelle' AS source FROM obs UNION ALL SELECT 'zweite' FROM book) GROUP BY 1",
)
def _(t):
    jobs.register_source("tabelle", lambda spark, options: t.obs.select("id", "title"))
    jobs.register_source("zweite", lambda spark, options: t.book.select("title"))
    found = jobs.read_sources(t.spark, {"tabelle": {}, "zweite": {}})
    return found.groupBy("source").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------ seed

_LIKED = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Ohne Trenner ' || c_custkey
  ELSE 'Titel ' || c_mktsegment || ' - Anna Meier (Notiz)' END AS line FROM customer"""


def _seed(t):
    slug = F.concat(F.lit("p"), c("item_id") % 3)
    wl = t.watchlist.withColumnRenamed("entry_id", "item_id").withColumn("note", F.lit(None).cast("string"))
    liked = t.customer.select(
        c("c_custkey").alias("item_id"),
        F.when(c("c_nationkey") % 2 == 0, "liked").otherwise("disliked").alias("kind"),
        F.when(c("c_custkey") % 4 == 0, F.concat(F.lit("Ohne Trenner "), "c_custkey"))
        .otherwise(F.concat(F.lit("Titel "), "c_mktsegment", F.lit(" - Anna Meier (Notiz)"))).alias("line"),
    )
    owned = t.book.select(
        c("book_id").alias("item_id"), "title", "author",
        F.when(c("book_id") % 3 == 0, (c("book_id") % 6).cast("int")).alias("stars"),
        F.lit(None).cast("string").alias("note"),
    )
    return jobs.seed_rows(*[x.withColumn("profile_slug", slug) for x in (wl, liked, owned)])


@query(
    "q_09_seed_rows",
    """SELECT 'p' || entry_id % 3 AS profile_slug, 'watching' AS kind, entry_id AS item_id, title, author,
  CASE WHEN check_library <> check_shop THEN CASE WHEN check_library THEN 'library' ELSE 'shop' END END AS restriction, NULL AS note FROM watchlist
UNION ALL SELECT 'p' || c_custkey % 3, CASE WHEN c_nationkey % 2 = 0 THEN 'liked' ELSE 'disliked' END, c_custkey,
  'Titel ' || c_mktsegment, 'Anna Meier', NULL, 'Notiz' FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT 'p' || book_id % 3, 'owned', book_id, title, author, NULL, NULL FROM book""",
)
def _(t):
    return _seed(t)[0].select("profile_slug", "kind", "item_id", "title", "author", "restriction", "note")


@query(
    "agg_17_seed_report",
    """SELECT profile_slug, sum(r) AS relations, sum(s) AS ratings, sum(u) AS unresolved, sum(i) AS interests FROM (
  SELECT 'p' || entry_id % 3 AS profile_slug, 1 AS r, 0 AS s, 0 AS u, 0 AS i FROM watchlist
  UNION ALL SELECT 'p' || c_custkey % 3, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END, 0, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END, 0 FROM customer
  UNION ALL SELECT 'p' || book_id % 3, 1, CASE WHEN book_id % 3 = 0 THEN 1 ELSE 0 END, 0, 0 FROM book
  UNION ALL SELECT profile_slug, 0, 0, 0, 1 FROM (SELECT DISTINCT profile_slug, interest_key, value FROM interest_log)) GROUP BY 1""",
)
def _(t):
    rows, lost = _seed(t)
    return jobs.seed_report(rows, lost, state.interests(t.interest_log))


@query("q_09_seeded_books")
def _(t):
    from folioflux.operators import linkage

    rows, _ = _seed(t)
    # Titles of one seed, each with a number of its own.
    items = rows.select(
        F.concat_ws(":", "kind", F.lpad(c("item_id").cast("string"), 12, "0")).alias("item_id"),
        F.lit(None).cast("string").alias("isbn"), "title", "author",
        F.lit(None).cast("string").alias("series"),
    )
    return linkage.find_or_create(items, t.book)[0]


# ------------------------------------------------------------------------- run

_RUN_GATE = _GATE.replace("FROM delta d", "FROM run_delta d")
_RUN_DIGEST = _DIGEST.replace(
    "FROM delta d LEFT JOIN advantages a USING (id)",
    f"FROM (SELECT * FROM ({_RUN_GATE}) WHERE decision <> 'held_back') d LEFT JOIN run_advantages a USING (id)",
)


def _kept(name: str, frame: DataFrame) -> DataFrame:
    """Frames that several others come from are written once."""
    return materialize(frame, name) if name in ("deltas", "decided") else frame


def _last_run(t, keep=_kept) -> jobs.Run:
    """The newest run of the log against all before it, with everything it reads."""
    last = t.obs.agg(F.max("run_id").alias("_last"))
    marked = t.obs.join(F.broadcast(last))  # one row: the number of the newest run
    sources, failed = jobs.collecting_sources(t.obs, t.switch_log, t.probe_log)
    # Written: nearly every frame of the run starts from its own rows.
    current = materialize(
        marked.filter("run_id = _last").drop("_last").join(sources, "source", "left_semi"), "run-rows"
    )
    earlier = marked.filter("run_id < _last").drop("_last")
    wanted = state.interests(t.interest_log)
    places = t.obs.select("profile_slug", "source").distinct().join(sources, "source", "left_semi")
    return jobs.Run(
        observations=current, log=earlier, books=t.book, ratings=state.ratings(t.rating_log),
        edges=t.contains,
        origin=collect.origins(current, search_hits(t), wanted).select(*ITEM, "interest_id"),
        seeded_before=state.seeded(t.seed_log),
        swept=collect.swept(wanted.filter("active"), places),
        attention=attention_of(t), failures=failures_of(t), failed=failed,
        profile=PROFILE, run_time=now(), rate=_rate, keep=keep,
    )


def _commit_last_run(t, base: str) -> None:
    writer = sinks.RunWriter(t.spark, base, t.obs.agg(F.max("run_id")).first()[0])
    _last_run(t, writer.keep).write()
    writer.commit()


@query("q_10_run_deltas", f"SELECT id, kind, decision FROM ({_RUN_GATE})")
def _(t):
    return _last_run(t).decided.select("id", "kind", "decision")


@query("q_10_run_digest", _RUN_DIGEST)
def _(t):
    return _last_run(t).digest.select("section_rank", "id", "title", "detail", "flag")


@query(
    "q_10_run_seeding",
    """SELECT DISTINCT i.interest_id, s.source FROM interest i JOIN (SELECT DISTINCT profile_slug, source FROM obs) s USING (profile_slug)
WHERE i.active AND s.source NOT IN (SELECT source FROM failed_source)
  AND s.source NOT IN (SELECT source FROM switch_log GROUP BY 1 HAVING NOT arg_max(enabled, seq))""",
)
def _(t):
    return _last_run(t).seeded.select("interest_id", "source")


@query(
    "q_10_run_learned",
    """SELECT book_id, isbn FROM (
  SELECT * FROM (SELECT o.id, o.book_id, o.isbn FROM run_obs o JOIN book b ON b.book_id = o.book_id
    WHERE b.isbn IS NULL AND o.isbn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM book x WHERE x.isbn = o.isbn)
    QUALIFY row_number() OVER (PARTITION BY o.book_id ORDER BY id) = 1)
  QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY id) = 1)""",
)
def _(t):
    return _last_run(t).learned


@query(
    "q_10_run_foreign",
    f"""SELECT subject, CAST(rating AS DOUBLE) AS stars, 'Durchschnitt der Leser:innen aus ' || rating_votes || ' Stimmen' AS reason
FROM (SELECT *, {S.SUBJECT} AS subject FROM run_obs WHERE rating IS NOT NULL AND rating_votes > 0
  QUALIFY row_number() OVER (PARTITION BY {S.SUBJECT} ORDER BY id DESC) = 1)""",
)
def _(t):
    return _last_run(t).foreign.select("subject", "stars", "reason")


@query(
    "q_10_run_report",
    f"""SELECT profile_slug, run_id, count(*) AS deltas, count(*) FILTER (decision <> 'held_back') AS shown,
  count(*) FILTER (decision = 'held_back') AS held_back, count(*) FILTER (fresh) AS rated,
  count(*) FILTER (rated IS NOT NULL AND match_reason <> 'watchlist') AS reused,
  count(*) FILTER (decision = 'unrated') AS unrated, count(*) FILTER (decision = 'over_budget') AS over_budget,
  count(*) FILTER (decision = 'shown_unsure') AS shown_unsure FROM ({_RUN_GATE}) GROUP BY 1, 2""",
)
def _(t):
    return _last_run(t).report


@query(
    "q_10_run_journal",
    f"""SELECT r.profile_slug, r.run_id, {SQL_NOW} AS finished_at, CASE WHEN e.error IS NULL THEN 'ok' ELSE 'error' END AS status,
  coalesce(n.n, 0) AS delta_count, e.error FROM (SELECT DISTINCT profile_slug, run_id FROM run_obs) r
LEFT JOIN (SELECT profile_slug, count(*) AS n FROM ({_RUN_GATE}) WHERE decision <> 'held_back' GROUP BY 1) n USING (profile_slug)
CROSS JOIN (SELECT string_agg(concat_ws(': ', source, message), '; ' ORDER BY source) AS error FROM failed_source) e""",
)
def _(t):
    return _last_run(t).journal


_RUN_ROWS = """SELECT id, run_id, CASE WHEN book_id IS NULL THEN blurb END AS blurb, observed_at FROM run_obs"""


@query("q_10_committed_rows", _RUN_ROWS)
def _(t):
    """The run committed twice: what is read back is the second whole run."""
    base = shared_folder(t.spark, "runs")
    _commit_last_run(t, base)
    _commit_last_run(t, base)
    return sinks.committed(t.spark, base, "rows").select("id", "run_id", "blurb", "observed_at")


@query("q_10_committed_digest", _RUN_DIGEST)
def _(t):
    base = shared_folder(t.spark, "runs")
    _commit_last_run(t, base)
    return sinks.committed(t.spark, base, "digest").select("section_rank", "id", "title", "detail", "flag")


@query(
    "q_11_one_entry_run",
    "SELECT id FROM obs WHERE match_reason = 'watchlist' AND title = 'Kaltes Eis'",
)
def _(t):
    return jobs.one_entry(t.obs, c("title") == "Kaltes Eis").select("id")


_REQUEST = """SELECT o_orderkey AS request_id, 'p' || o_custkey % 3 AS profile_slug, o_custkey AS book_id FROM orders"""
_GOOD = """(SELECT source FROM (SELECT DISTINCT source FROM obs) WHERE source NOT IN (SELECT source FROM failed_source)
  AND source NOT IN (SELECT source FROM switch_log GROUP BY 1 HAVING NOT arg_max(enabled, seq)))"""
_COLLECTED = f"""SELECT q.request_id, o.id FROM ({_REQUEST}) q JOIN entry e ON e.profile_slug = q.profile_slug AND e.book_id = q.book_id
JOIN link l ON l.book_id = q.book_id JOIN obs_latest o ON o.profile_slug = q.profile_slug AND o.source = l.source
  AND o.source_item_id = l.source_item_id
WHERE e.active AND l.source IN {_GOOD}
  AND coalesce(e.restriction = CASE WHEN l.source IN ('view', 'signup') THEN 'library' ELSE 'shop' END, TRUE)"""


def _entry_runs(t) -> tuple[DataFrame, DataFrame]:
    requests = t.orders.select(
        c("o_orderkey").alias("request_id"), F.concat(F.lit("p"), c("o_custkey") % 3).alias("profile_slug"),
        c("o_custkey").alias("book_id"),
    )
    sources, failed = jobs.collecting_sources(t.obs, t.switch_log, t.probe_log)
    latest = ordered.latest(t.obs.select(*ITEM, "id", "price_cents", "availability"), ITEM)
    return jobs.entry_runs(
        requests, _entries(t), latest, state.links(t.link_log), sources, failed, PROFILE, now()
    )


@query("q_11_entry_rows", _COLLECTED)
def _(t):
    return _entry_runs(t)[0].select("request_id", "id")


@query(
    "q_11_entry_journal",
    f"""SELECT q.request_id, CASE WHEN NOT coalesce(e.active, FALSE) OR f.well + f.bad = 0 THEN 'refused'
    WHEN f.bad > 0 THEN 'failed' ELSE 'ok' END AS status, coalesce(n.n, 0) AS delta_count,
  CASE WHEN e.active IS NULL THEN 'no entry' WHEN NOT e.active THEN 'paused' WHEN f.well + f.bad = 0 THEN 'no source'
    ELSE f.said END AS trouble FROM ({_REQUEST}) q
LEFT JOIN entry e ON e.profile_slug = q.profile_slug AND e.book_id = q.book_id
LEFT JOIN (SELECT request_id, count(*) AS n FROM ({_COLLECTED}) GROUP BY 1) n USING (request_id)
CROSS JOIN (SELECT string_agg(source, '; ' ORDER BY source) AS said, count(*) AS bad,
  (SELECT count(*) FROM {_GOOD}) AS well FROM failed_source) f""",
)
def _(t):
    return _entry_runs(t)[1].select("request_id", "status", "delta_count", "trouble")


_WANTED = """SELECT profile_slug, isbn, max(id) AS last_seen,
  row_number() OVER (PARTITION BY profile_slug ORDER BY max(id) DESC) AS rank FROM obs
WHERE isbn <> '' AND isbn NOT IN (SELECT isbn FROM record_log) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY profile_slug ORDER BY max(id) DESC) <= 50"""
_ASKED = f"""SELECT w.*, a.title, a.series, CASE WHEN a.throttled THEN 'throttled' WHEN a.found IS NULL THEN 'failed'
    WHEN a.found THEN 'found' ELSE 'nothing' END AS outcome
FROM ({_WANTED}) w LEFT JOIN record_answer a ON a.isbn = w.isbn
WHERE NOT EXISTS (SELECT 1 FROM ({_WANTED}) x JOIN record_answer y ON y.isbn = x.isbn
  WHERE y.throttled AND x.profile_slug = w.profile_slug AND x.rank < w.rank)"""
_ALL_RECORDS = f"""SELECT isbn, seq, found, title, series FROM record_log
UNION ALL SELECT isbn, (SELECT max(seq) FROM record_log) + max(last_seen) + 1, any_value(outcome) = 'found',
  any_value(title), any_value(series) FROM ({_ASKED}) WHERE outcome IN ('found', 'nothing') GROUP BY isbn"""


def _enrichment(t) -> records.Enrichment:
    return records.enrich(
        t.obs, t.record_log, t.record_answer, t.contains, PROFILE.record_budget, now()
    )


@query(
    "q_12_record_enrichment",
    f"""SELECT a.isbn, count(e.contained) AS volumes FROM (SELECT DISTINCT isbn FROM ({_ASKED}) WHERE outcome = 'found') a
LEFT JOIN contains e ON e.isbn = a.isbn GROUP BY 1""",
)
def _(t):
    found = _enrichment(t)
    answered = found.records.filter("found").select("isbn")
    return answered.join(found.edges, "isbn", "left").groupBy("isbn").agg(
        F.count("contained").alias("volumes")
    )


@query("q_12_asked_isbns", f"SELECT profile_slug, isbn, rank, outcome FROM ({_ASKED})")
def _(t):
    return _enrichment(t).asked


@query(
    "q_12_enrichment_report",
    f"""SELECT profile_slug, count(*) AS asked, count(*) FILTER (outcome = 'found') AS answered,
  bool_or(outcome = 'throttled') AS halted FROM ({_ASKED}) GROUP BY 1""",
)
def _(t):
    return _enrichment(t).report


@query(
    "q_12_enriched_cache",
    f"""SELECT isbn, arg_max(found, seq) AS found, arg_max(title, seq) FILTER (found) AS title,
  (SELECT list(r.series ORDER BY r.seq DESC)[1] FROM ({_ALL_RECORDS}) r WHERE r.isbn = x.isbn AND r.found) AS series
FROM ({_ALL_RECORDS}) x GROUP BY 1""",
)
def _(t):
    return _enrichment(t).cache.select("isbn", "found", "title", "series")


@query(
    "q_12_enriched_edges",
    f"""SELECT isbn, contained FROM contains WHERE isbn IN (SELECT isbn FROM ({_ASKED}) WHERE outcome = 'found')""",
)
def _(t):
    return _enrichment(t).edges


@query(
    "q_13_repaired_blurbs",
    f"""SELECT id, nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(cut,
  '(?i)\\s*(Mehr|Weiterlesen|mehr lesen)?\\s*(navigate_next|expand_more|expand_less)\\s*$', ''),
  '\\s*\\b(navigate_next|expand_more|expand_less)\\b\\s*', ' ', 'g'), '\\s+', ' ', 'g')),
  '(?i)\\s*(alles anzeigen|weniger anzeigen|mehr anzeigen|weiterlesen)\\s*$', '')), '') AS blurb
FROM (SELECT id, CASE WHEN contains(blurb, 'alles anzeigen')
  THEN regexp_replace(blurb, '^.*alles anzeigen expand_more ', '') ELSE blurb END AS cut FROM obs)""",
)
def _(t):
    return jobs.repaired_blurbs(t.obs.select("id", "blurb"))


@query(
    "q_13_renamed_source",
    """SELECT book_id, 'click' AS source, coalesce(max(seq) FILTER (source = 'click'), max(seq)) AS seq
FROM link WHERE source IN ('click', 'view') GROUP BY 1
UNION ALL SELECT book_id, source, seq FROM link WHERE source NOT IN ('click', 'view')""",
)
def _(t):
    return jobs.renamed_source(
        state.links(t.link_log), "view", "click", ["book_id", "source"]
    ).select("book_id", "source", "seq")


@query(
    "q_13_renamed_subjects",
    """SELECT subject, origin, arg_min(seq, (moved, seq)) AS seq FROM (
  SELECT CASE WHEN subject LIKE 'item:view:%' THEN 'item:click:' || substr(subject, 11) ELSE subject END AS subject,
    CASE WHEN origin = 'reader' THEN 'conversation' ELSE origin END AS origin, seq,
    origin = 'reader' OR subject LIKE 'item:view:%' AS moved FROM rating) GROUP BY 1, 2""",
)
def _(t):
    # Both repairs at once; a row already under its new key wins.
    moved = jobs.renamed_keys(
        state.ratings(t.rating_log), ("view", "click"), ("reader", "conversation")
    )
    return moved.select("subject", "origin", "seq")


@query(
    "q_14_on_demand_judgement",
    """SELECT o.profile_slug, o.book_id, o.id, CASE WHEN (coalesce(length(o.blurb), 0) = 0 OR regexp_matches(o.blurb, '(\\.\\.\\.|…)\\s*$'))
  AND length(b.blurb) > 0 THEN b.blurb ELSE o.blurb END AS blurb
FROM (SELECT * FROM obs WHERE book_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY profile_slug, book_id ORDER BY id DESC) = 1) o
LEFT JOIN book b ON b.book_id = o.book_id""",
)
def _(t):
    return jobs.newest_for_judgement(t.obs, t.book).select("profile_slug", "book_id", "id", "blurb")


@query(
    "q_15_covers_to_fetch",
    """SELECT DISTINCT cover_url FROM (
  SELECT 'https://img.example/q/' || l.seq || '.png' AS cover_url FROM link l JOIN relation r USING (book_id)
    WHERE l.outcome = 'unsure' AND r.active AND r.kind = 'watching'
  UNION ALL SELECT cover_url FROM pile WHERE status = 'shown'
  UNION ALL SELECT cover_url FROM (SELECT o.* FROM obs o JOIN book b ON b.book_id = o.book_id
    WHERE b.cover_file IS NULL AND o.cover_url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY o.book_id ORDER BY id) = 1)) WHERE cover_url IS NOT NULL
  AND substr(sha256(cover_url), 1, 12) || '.jpg' NOT IN (
    SELECT substr(sha256(cover_url), 1, 12) || '.jpg' FROM obs WHERE cover_url IS NOT NULL AND source = 'error')""",
)
def _(t):
    questions = watchlist.open_questions(
        state.links(t.link_log), state.relations(t.relation_log)
    ).select(F.concat(F.lit("https://img.example/q/"), "seq", F.lit(".png")).alias("cover_url"))
    shown = piles.suggestions(pile_of(t), PROFILE)
    stored = t.obs.filter("source = 'error' and cover_url is not null").select(
        C.file_name(c("cover_url")).alias("file")
    )
    return jobs.covers_to_fetch(
        questions, shown, jobs.first_cover_per_book(t.obs, t.book), stored
    ).select("cover_url")


@query(
    "q_16_source_probe",
    """SELECT source, count(*) AS rows, count(price_cents) AS priced, count(*) FILTER (coalesce(title, '') = '') AS broken,
  count(price_cents) > 0 AS ok FROM obs GROUP BY 1""",
)
def _(t):
    return jobs.healthy_sources(t.obs).select("source", "rows", "priced", "broken", "ok")


@query(
    "q_17_source_list",
    """SELECT s.source, coalesce(w.enabled, TRUE) AS enabled, p.last_ok, p.failures FROM (SELECT DISTINCT source FROM obs) s
LEFT JOIN (SELECT source, arg_max(enabled, seq) AS enabled FROM switch_log GROUP BY 1) w USING (source)
LEFT JOIN (SELECT source, arg_max(ok, seq) AS last_ok, count(*) FILTER (NOT ok AND seq > coalesce(last_good, -1)) AS failures
  FROM probe_log LEFT JOIN (SELECT source, max(seq) AS last_good FROM probe_log WHERE ok GROUP BY 1) USING (source)
  GROUP BY 1) p USING (source)""",
)
def _(t):
    names = t.obs.select("source").distinct()
    return state.enabled(names, t.switch_log).join(
        state.probe_state(t.probe_log), "source", "left"
    ).select("source", "enabled", "last_ok", "failures")


@query(
    "st_05_decided_finds",
    f"""SELECT f.id, d.kind FROM finds f JOIN (SELECT DISTINCT profile_slug,
    CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS source,
    CAST(o_custkey AS varchar) AS source_item_id, kind FROM (
  SELECT o_orderkey, o_custkey, 'p' || o_custkey % 3 AS profile_slug,
    CASE o_orderstatus WHEN 'F' THEN 'owned' WHEN 'O' THEN 'dismissed' ELSE 'egal' END AS kind FROM orders)
  WHERE kind <> 'egal') d USING (profile_slug, source, source_item_id)""",
)
def _(t):
    keys = t.orders.selectExpr(
        "concat('p', o_custkey % 3) as profile_slug",
        "case o_orderkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'signup' else 'error' end as source",
        "cast(o_custkey as string) as source_item_id",
        "case o_orderstatus when 'F' then 'owned' when 'O' then 'dismissed' else 'egal' end as kind",
    ).distinct()
    finds = lookups.latest_discoveries(t.obs.select(*ITEM, "id", "match_reason"))
    good, _ = piles.decisions(keys, finds, ["watching", "owned", "liked", "disliked", "dismissed"])
    return good.select("id", "kind")


def _decided_finds(t) -> decide.Decided:
    """What the decisions of ``st_05_decided_finds`` add to books, relations and links."""
    keys = t.orders.selectExpr(
        "concat('p', o_custkey % 3) as profile_slug",
        "case o_orderkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'signup' else 'error' end as source",
        "cast(o_custkey as string) as source_item_id",
        "case o_orderstatus when 'F' then 'owned' when 'O' then 'dismissed' else 'egal' end as kind",
    ).distinct()
    facts = ["id", "match_reason", "isbn", "title", "author", "series", "url"]
    finds = lookups.latest_discoveries(t.obs.select(*ITEM, *facts))
    good, _ = piles.decisions(keys, finds, ["watching", "owned", "liked", "disliked", "dismissed"])
    return decide.decide(good, t.book, now())


@query("st_05_decided_books")
def _(t):
    return _decided_finds(t).books


@query("st_05_decided_relations")
def _(t):
    return _decided_finds(t).relations


@query("st_05_decided_links")
def _(t):
    return _decided_finds(t).links


@query("st_07_added_to_watchlist")
def _(t):
    from folioflux.operators import linkage

    items = t.watchlist.filter("active").select(
        c("entry_id").alias("item_id"), F.lit(None).cast("string").alias("isbn"), "title", "author",
        F.lit(None).cast("string").alias("series"),
    )
    assigned, _ = linkage.find_or_create(items, t.book)
    return assigned.select(
        F.lit("p0").alias("profile_slug"), "book_key", F.lit("watching").alias("kind")
    ).distinct()
