"""Joins between finds, books, links, relations and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import catalogue as C
from folioflux.operators import lookups, state
from folioflux.operators.changes import ITEM
from folioflux.plans import gate, pages, watchlist
from folioflux.workload import sqltext as S
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col


@query("join_04_decided_items", "SELECT * FROM decided_item")
def _(t):
    return lookups.decided_items(state.links(t.link_log), state.relations(t.relation_log))


@query("join_05_isbns_with_relations", "SELECT profile_slug, isbn, book_id FROM decided_isbn")
def _(t):
    return lookups.decided_isbns(t.book, state.relations(t.relation_log))


@query(
    "join_06_dismissed_keys",
    """SELECT DISTINCT r.profile_slug, coalesce(l.source || ':' || l.source_item_id, '') AS item_key, '' AS isbn
FROM link l JOIN relation r USING (book_id) WHERE r.active AND r.kind = 'dismissed' AND l.source_item_id IS NOT NULL
UNION ALL SELECT DISTINCT r.profile_slug, '', b.isbn FROM book b JOIN relation r USING (book_id)
WHERE r.active AND r.kind = 'dismissed' AND b.isbn IS NOT NULL""",
)
def _(t):
    items, isbns = lookups.dismissed_keys(
        state.links(t.link_log), t.book, state.relations(t.relation_log)
    )
    return items.select(
        "profile_slug", C.find_key(c("source"), c("source_item_id")).alias("item_key"),
        F.lit("").alias("isbn"),
    ).unionByName(isbns.select("profile_slug", F.lit("").alias("item_key"), "isbn"))


@query(
    "join_07_not_dismissed",
    """SELECT o.id FROM obs o WHERE NOT EXISTS (SELECT 1 FROM link l JOIN relation r USING (book_id)
    WHERE r.active AND r.kind = 'dismissed' AND r.profile_slug = o.profile_slug
      AND l.source = o.source AND l.source_item_id = o.source_item_id)
  AND NOT EXISTS (SELECT 1 FROM book b JOIN relation r USING (book_id)
    WHERE r.active AND r.kind = 'dismissed' AND r.profile_slug = o.profile_slug AND b.isbn = o.isbn)""",
)
def _(t):
    items, isbns = lookups.dismissed_keys(
        state.links(t.link_log), t.book, state.relations(t.relation_log)
    )
    return lookups.not_covered(t.obs, items, isbns).select("id")


@query(
    "join_08_unseeded_suppressed",
    """SELECT d.id, d.kind FROM delta d
LEFT JOIN (SELECT profile_slug, source, source_item_id, CAST(source_item_id AS BIGINT) % 50 AS interest_id
  FROM obs WHERE match_reason <> 'watchlist' AND CAST(source_item_id AS BIGINT) % 3 > 0
  GROUP BY ALL) o USING (profile_slug, source, source_item_id)
LEFT JOIN (SELECT DISTINCT o_custkey % 60 AS interest_id,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'click' WHEN '2' THEN 'view' ELSE 'purchase' END AS source
  FROM orders WHERE o_orderstatus = 'P') s ON s.interest_id = o.interest_id AND s.source = d.source
WHERE d.kind <> 'first_seen' OR d.match_reason = 'watchlist' OR o.interest_id IS NULL OR s.interest_id IS NOT NULL""",
)
def _(t):
    from folioflux.operators import changes
    from folioflux.workload.changes import compared

    deltas = changes.notifiable(changes.changes(compared(t), PROFILE))
    number = c("source_item_id").cast("long")
    origin = (
        t.obs.filter((c("match_reason") != "watchlist") & (number % 3 > 0))
        .select(*ITEM, (number % 50).alias("interest_id")).distinct()
    )
    seeded = t.orders.filter("o_orderstatus = 'P'").select(
        (c("o_custkey") % 60).alias("interest_id"),
        F.when(c("o_orderpriority").startswith("1"), "click").when(c("o_orderpriority").startswith("2"), "view")
        .otherwise("purchase").alias("source"),
    )
    return changes.suppress_unseeded(deltas, origin, seeded).select("id", "kind")


_JUDGED = f"""SELECT o.id, coalesce(rd.seq, cv.seq, md.seq) AS seq,
  coalesce(rd.stars, cv.stars, md.stars) AS stars
FROM (SELECT *, {S.SUBJECT} AS subject FROM obs) o
LEFT JOIN rating rd ON rd.origin = 'reader' AND rd.subject = 'book:' || o.book_id
LEFT JOIN rating cv ON cv.origin = 'conversation' AND cv.profile_version = 1 AND cv.subject = 'book:' || o.book_id
LEFT JOIN rating md ON md.origin = 'model' AND md.profile_version = 1 AND md.subject = o.subject"""


@query("join_09_judgement", f"SELECT id, stars FROM ({_JUDGED})")
def _(t):
    return gate.with_judgement(t.obs, state.ratings(t.rating_log), 1).select(
        "id", "judgement.stars"
    )


@query(
    "join_10_ratings_for_subjects",
    f"SELECT r.subject, r.origin, r.stars FROM rating r WHERE subject IN (SELECT {S.SUBJECT} FROM obs)",
)
def _(t):
    subjects = t.obs.select(
        C.subject_of(c("isbn"), c("source"), c("source_item_id")).alias("subject")
    ).distinct()
    return state.ratings(t.rating_log).join(subjects, "subject", "left_semi").select(
        "subject", "origin", "stars"
    )


@query(
    "join_11_book_judgements",
    f"""SELECT book_id, origin, stars, profile_version FROM (
  SELECT DISTINCT book_id, 'book:' || book_id AS subject, TRUE AS at_book FROM book
  UNION SELECT book_id, 'isbn:' || isbn, FALSE FROM book WHERE isbn IS NOT NULL
  UNION SELECT book_id, {S.SUBJECT}, FALSE FROM obs WHERE book_id IS NOT NULL) s
JOIN rating r USING (subject) WHERE at_book OR origin IN ('model', 'onleihe_readers')
QUALIFY row_number() OVER (PARTITION BY book_id, origin ORDER BY seq DESC) = 1""",
)
def _(t):
    books = t.book.select("book_id", "isbn")
    subjects = (
        books.select("book_id", C.book_subject(c("book_id")).alias("subject"), F.lit(True).alias("at_book"))
        .unionByName(
            books.filter("isbn is not null").select(
                "book_id", F.concat(F.lit("isbn:"), "isbn").alias("subject"), F.lit(False).alias("at_book")
            )
        )
        .unionByName(
            t.obs.filter("book_id is not null").select(
                "book_id", C.subject_of(c("isbn"), c("source"), c("source_item_id")).alias("subject"),
                F.lit(False).alias("at_book"),
            )
        )
    )
    return pages.judgements(subjects, state.ratings(t.rating_log), ["book_id"]).select(
        "book_id", "origin", "stars", "profile_version"
    )


@query(
    "join_15_open_questions",
    """SELECT l.book_id, l.source, r.profile_slug, l.matched_title FROM link l JOIN relation r USING (book_id)
WHERE l.outcome = 'unsure' AND r.active AND r.kind = 'watching'""",
)
def _(t):
    return watchlist.open_questions(state.links(t.link_log), state.relations(t.relation_log)).select(
        "book_id", "source", "profile_slug", "matched_title"
    )


@query(
    "join_16_watched_books",
    "SELECT profile_slug, book_id, title, active, restriction FROM entry",
)
def _(t):
    from folioflux.workload.filters import _entries

    return _entries(t).select("profile_slug", "book_id", "title", "active", "restriction")


@query(
    "join_17_book_by_item",
    "SELECT o.id, l.book_id FROM finds o JOIN link l ON l.source = o.source AND l.source_item_id = o.source_item_id",
)
def _(t):
    links = state.links(t.link_log).filter("source_item_id is not null").select(
        "source", "source_item_id", c("book_id").alias("linked")
    )
    finds = lookups.latest_discoveries(t.obs.select(*ITEM, "id", "match_reason"))
    return finds.join(links, ["source", "source_item_id"]).select("id", c("linked").alias("book_id"))


@query(
    "join_18_full_blurbs",
    """SELECT o.id, CASE WHEN o.blurb IS NULL OR regexp_matches(o.blurb, '(\\.\\.\\.|…)\\s*$')
  THEN coalesce(d.text, o.blurb) ELSE o.blurb END AS blurb
FROM finds o LEFT JOIN (SELECT doc_id, text FROM documents) d ON CAST(d.doc_id AS varchar) = o.source_item_id""",
)
def _(t):
    from folioflux.plans.jobs import fill_blurbs

    details = t.documents.select(
        c("doc_id").cast("string").alias("source_item_id"), c("text").alias("detail_blurb"),
        F.lit(None).cast("string").alias("detail_cover"),
    )
    finds = lookups.latest_discoveries(
        t.obs.select(*ITEM, "id", "match_reason", "blurb", "cover_url")
    )
    return fill_blurbs(finds, details, ["source_item_id"]).select("id", "blurb")


@query(
    "join_19_configuration",
    """SELECT profile_slug, CASE WHEN interest_key = 'thema' THEN 'theme' ELSE tier END AS channel, value AS name
FROM (SELECT profile_slug, interest_key, value, arg_max(active, seq) AS active, arg_max(tier, seq) AS tier
  FROM interest_log GROUP BY 1, 2, 3) WHERE active
UNION ALL SELECT r.profile_slug, 'entry', b.title FROM relation r JOIN book b USING (book_id)
WHERE r.kind = 'watching' AND r.active""",
)
def _(t):
    from folioflux.sources.collect import configuration

    return configuration(
        state.interests(t.interest_log), state.relations(t.relation_log), t.book
    ).select("profile_slug", "channel", "name")


@query(
    "join_21_entry_of_book",
    """SELECT w.entry_id, b.book_id FROM watchlist w JOIN book b
  ON lower(trim(w.title)) = lower(trim(b.title))
 AND coalesce(nullif(lower(trim(w.author)), ''), '') = coalesce(lower(trim(b.author)), '')""",
)
def _(t):
    from folioflux.operators.linkage import entry_of_book

    return entry_of_book(t.book, t.watchlist).select("entry_id", "book_id")


@query(
    "win_08_rating_budget",
    f"""SELECT id, CAST(ask_rank AS INT) AS ask_rank FROM (
  SELECT d.id, row_number() OVER (PARTITION BY d.profile_slug, d.run_id ORDER BY d.id) AS ask_rank
  FROM delta d JOIN ({_JUDGED}) j USING (id)
  WHERE d.kind = 'first_seen' AND d.match_reason <> 'watchlist' AND j.seq IS NULL) WHERE ask_rank <= 40""",
)
def _(t):
    from folioflux.operators import changes
    from folioflux.workload.changes import compared

    deltas = changes.notifiable(changes.changes(compared(t), PROFILE))
    judged = gate.with_judgement(deltas, state.ratings(t.rating_log), 1)
    return gate.to_ask(judged, PROFILE.rating_budget, ["profile_slug", "run_id"]).select(
        "id", "ask_rank"
    )


@query(
    "win_09_rating_batches",
    """SELECT id, CAST((rn - 1) // 20 AS BIGINT) AS batch, CAST((rn - 1) % 20 + 1 AS INT) AS number FROM (
  SELECT id, row_number() OVER (PARTITION BY profile_slug ORDER BY id) AS rn FROM finds)""",
)
def _(t):
    finds = lookups.latest_discoveries(t.obs.select(*ITEM, "id", "match_reason"))
    return gate.batches(finds, 20, ["profile_slug"]).select("id", "batch", "number")


@query(
    "win_11_first_claim",
    f"""SELECT {S.ITEM}, run_id, arg_min(id, (CASE match_reason WHEN 'watchlist' THEN 0
  WHEN 'profile_author' THEN 1 ELSE 2 END, id)) AS id FROM obs GROUP BY ALL""",
)
def _(t):
    from folioflux.sources.collect import first_claim

    return first_claim(t.obs.select(*ITEM, "run_id", "match_reason", "id")).select(
        *ITEM, "run_id", "id"
    )


@query(
    "agg_08_gate_counters_without_rater",
    """SELECT profile_slug, count(*) FILTER (kind = 'first_seen' AND match_reason <> 'watchlist') AS unrated
FROM delta GROUP BY 1""",
)
def _(t):
    from folioflux.operators import changes
    from folioflux.workload.changes import compared

    deltas = changes.notifiable(changes.changes(compared(t), PROFILE))
    decided = gate.apply(deltas, state.ratings(t.rating_log), PROFILE, ["profile_slug", "run_id"], None)
    return decided.groupBy("profile_slug").agg(
        F.count_if(c("decision") == "unrated").alias("unrated")
    )
