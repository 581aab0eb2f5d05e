"""Keyed state reduced from change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import ordered, state
from folioflux.workload.registry import query

c = F.col

_RELATIONS = """SELECT profile_slug, book_id, kind, arg_max(active, seq) AS active,
  arg_max(details, seq) FILTER (details IS NOT NULL) AS details, min(created_at) AS created_at
FROM relation_log GROUP BY 1, 2, 3"""


@query("st_01_relations", _RELATIONS)
def _(t):
    return state.relations(t.relation_log).drop("first_seq")


@query(
    "st_02_replaced_details",
    """SELECT profile_slug, book_id, kind, arg_max(details, seq) FILTER (details IS NOT NULL) AS details
FROM (SELECT seq, profile_slug, book_id, kind, details FROM relation_log
  UNION ALL SELECT seq + 100000000, profile_slug, book_id, kind, '{}' FROM relation_log WHERE seq % 9 = 0)
GROUP BY 1, 2, 3""",
)
def _(t):
    log = t.relation_log
    emptied = log.filter("seq % 9 = 0").withColumn("seq", c("seq") + 100000000).withColumn(
        "details", F.lit("{}")
    )
    return state.relations(log.unionByName(emptied)).select(
        "profile_slug", "book_id", "kind", "details"
    )


@query(
    "st_03_relation_history",
    f"SELECT profile_slug, book_id, kind, created_at FROM ({_RELATIONS}) WHERE NOT active",
)
def _(t):
    return state.relations(t.relation_log).filter("not active").select(
        "profile_slug", "book_id", "kind", "created_at"
    )


@query(
    "st_04_finished_entries",
    """SELECT profile_slug, book_id, kind, arg_max(active, (seq, part)) AS active FROM (
  SELECT profile_slug, book_id, kind, active, seq, 0 AS part FROM relation_log
  UNION ALL SELECT profile_slug, book_id, kind, TRUE, seq + 100000000, 0 FROM relation_log
    WHERE seq % 13 = 0 AND kind IN ('owned', 'dismissed')
  UNION ALL SELECT profile_slug, book_id, 'watching', FALSE, seq + 100000000, 1 FROM relation_log
    WHERE seq % 13 = 0 AND kind IN ('owned', 'dismissed'))
GROUP BY 1, 2, 3""",
)
def _(t):
    log = t.relation_log.select("seq", "profile_slug", "book_id", "kind", "active")
    commands = log.filter("seq % 13 = 0").select(
        (c("seq") + 100000000).alias("seq"), "profile_slug", "book_id", "kind"
    )
    rows = state.finish_commands(commands)
    both = log.withColumn("part", F.lit(0)).unionByName(rows)
    return both.groupBy("profile_slug", "book_id", "kind").agg(
        F.max_by("active", F.struct("seq", "part")).alias("active")
    )


@query(
    "st_06_undone_decisions",
    """SELECT DISTINCT b.book_id, r.profile_slug, r.kind FROM link_log l JOIN relation_log r USING (book_id)
JOIN (SELECT source, source_item_id, arg_max(book_id, seq) AS book_id FROM link_log GROUP BY ALL) b
  ON b.source = l.source AND b.source_item_id = l.source_item_id
WHERE r.kind IN ('dismissed', 'owned', 'watching')""",
)
def _(t):
    from folioflux.plans.pile import undo

    keys = t.relation_log.select("profile_slug", "book_id", "kind").distinct()
    finds = t.link_log.filter("source_item_id is not null").select(
        "seq", "source", "source_item_id", "book_id"
    )
    wanted = finds.join(keys, "book_id").select("profile_slug", "source", "source_item_id", "kind")
    return undo(wanted, finds).select("book_id", "profile_slug", "kind").distinct()


@query(
    "st_08_interests",
    """SELECT profile_slug, interest_key, value, arg_max(active, seq) AS active, arg_max(tier, seq) AS tier,
  min(seq) AS interest_id FROM interest_log GROUP BY 1, 2, 3""",
)
def _(t):
    return state.interests(t.interest_log)


@query(
    "st_08_seeding_marks",
    "SELECT book_id AS interest_id, source, min(observed_at) AS seeded_at FROM obs WHERE book_id IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    marks = t.obs.filter("book_id is not null").select(
        c("book_id").alias("interest_id"), "source", c("observed_at").alias("seeded_at")
    )
    return state.seeded(marks)


_RATINGS = """SELECT * EXCLUDE (withdrawn) FROM (SELECT * FROM rating_log
  QUALIFY row_number() OVER (PARTITION BY subject, origin ORDER BY seq DESC) = 1) WHERE NOT withdrawn"""


@query("st_09_ratings", _RATINGS)
def _(t):
    return state.ratings(t.rating_log)


@query(
    "st_09_unknown_origins",
    "SELECT seq, origin FROM rating_log WHERE origin NOT IN ('model', 'reader')",
)
def _(t):
    return state.rejected_origins(t.rating_log, ["model", "reader"]).select("seq", "origin")


@query(
    "st_10_links",
    """SELECT book_id, source, seq, source_item_id, url, outcome FROM link_log
QUALIFY row_number() OVER (PARTITION BY book_id, source ORDER BY seq DESC) = 1""",
)
def _(t):
    return state.links(t.link_log).select(
        "book_id", "source", "seq", "source_item_id", "url", "outcome"
    )


@query(
    "st_11_rejected_candidates",
    """WITH ops AS (SELECT o_orderkey AS seq, o_custkey % 400 AS book_id, o_orderstatus AS source,
   'u' || (o_orderkey % 5) AS url, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'undo'
     WHEN '2' THEN 'restore' WHEN '3' THEN 'link' ELSE 'reject' END AS op FROM orders)
SELECT book_id, source, url FROM ops o WHERE op IN ('reject', 'undo')
  AND NOT EXISTS (SELECT 1 FROM ops x WHERE x.book_id = o.book_id AND x.source = o.source
    AND x.op IN ('restore', 'link') AND x.seq > o.seq)
GROUP BY 1, 2, 3 HAVING arg_max(op, seq) = 'reject'""",
)
def _(t):
    ops = t.orders.select(
        c("o_orderkey").alias("seq"), (c("o_custkey") % 400).alias("book_id"),
        c("o_orderstatus").alias("source"), F.concat(F.lit("u"), c("o_orderkey") % 5).alias("url"),
        F.expr(
            "case substr(o_orderpriority, 1, 1) when '1' then 'undo' when '2' then 'restore' "
            "when '3' then 'link' else 'reject' end"
        ).alias("op"),
    )
    return state.rejected_candidates(ops)


@query(
    "st_12_renamed_books",
    """WITH r AS (SELECT o_orderkey AS seq, o_custkey AS book_id,
    CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' Titel ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN 'Autor ' || o_orderkey END AS author
  FROM orders),
e AS (SELECT book_id, arg_max(trim(title), seq) AS title,
    arg_max(author, seq) FILTER (author IS NOT NULL) AS author, max(seq) AS seq,
    count(author) > 0 AS named FROM r WHERE trim(title) <> '' GROUP BY 1)
SELECT b.book_id, coalesce(e.title, b.title) AS title,
  CASE WHEN coalesce(named, FALSE) THEN nullif(trim(e.author), '') ELSE b.author END AS author,
  (SELECT count(*) FROM (SELECT book_id, source, max(seq) AS seq FROM link_log GROUP BY 1, 2) l
    WHERE l.book_id = b.book_id AND (e.seq IS NULL OR l.seq > e.seq)) AS links
FROM book b LEFT JOIN e USING (book_id)""",
)
def _(t):
    renames = t.orders.selectExpr(
        "o_orderkey as seq",
        "o_custkey as book_id",
        "case when o_orderkey % 7 = 0 then '  ' else concat(' Titel ', o_orderkey) end as title",
        "case when o_orderkey % 3 = 0 then ' ' when o_orderkey % 3 = 1 then concat('Autor ', o_orderkey) end as author",
    )
    kept = state.links(t.link_log, renames).groupBy("book_id").agg(F.count("*").alias("links"))
    named = state.rename_books(t.book.select("book_id", "title", "author"), renames)
    return named.join(kept, "book_id", "left").fillna(0, ["links"])


@query(
    "st_13_source_switch",
    """SELECT source, coalesce(enabled, TRUE) AS enabled FROM (SELECT DISTINCT source FROM obs)
LEFT JOIN (SELECT source, arg_max(enabled, seq) AS enabled FROM switch_log GROUP BY 1) USING (source)""",
)
def _(t):
    return state.enabled(t.obs.select("source").distinct(), t.switch_log)


@query(
    "st_14_run_journal",
    """SELECT profile_slug, run_id, started_at, finished_at, status,
  CASE WHEN finished_at IS NOT NULL THEN delta_count END AS delta_count FROM run_log""",
)
def _(t):
    runs = t.run_log
    starts = runs.select(
        "profile_slug", "run_id", F.lit("start").alias("event"), c("started_at").alias("at"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("delta_count"),
    )
    ends = runs.filter("finished_at is not null").select(
        "profile_slug", "run_id", F.lit("finish").alias("event"), c("finished_at").alias("at"),
        "status", "delta_count",
    )
    return state.run_journal(starts.unionByName(ends))


@query(
    "st_15_timestamp_state",
    "SELECT profile_slug, kind AS state_key, arg_max(created_at, seq) AS at FROM relation_log GROUP BY 1, 2",
)
def _(t):
    log = t.relation_log.select(
        "seq", "profile_slug", c("kind").alias("state_key"), c("created_at").alias("at")
    )
    return ordered.latest(log, ["profile_slug", "state_key"], "seq").drop("seq")


@query(
    "st_16_point_reads",
    """SELECT b.book_id, b.title, coalesce(c.cover, b.cover_file) AS cover_file FROM book b
LEFT JOIN (SELECT o_custkey AS book_id, arg_max('c' || o_orderkey || '.jpg', o_orderkey) AS cover
  FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) c USING (book_id)""",
)
def _(t):
    covers = t.orders.filter("o_orderstatus = 'O'").groupBy(c("o_custkey").alias("book_id")).agg(
        F.max_by(F.concat(F.lit("c"), "o_orderkey", F.lit(".jpg")), "o_orderkey").alias("cover")
    )
    return (
        t.book.join(covers, "book_id", "left")
        .select("book_id", "title", F.coalesce("cover", "cover_file").alias("cover_file"))
    )


@query(
    "st_17_acknowledged_missing",
    f"""SELECT book_id, profile_slug, b.title AS known_missing, json_extract_string(r.details, '$.note') AS note
FROM ({_RELATIONS}) r JOIN book b USING (book_id) WHERE r.kind = 'watching'""",
)
def _(t):
    watching = state.relations(t.relation_log).filter("kind = 'watching'").join(
        t.book.select("book_id", "title"), "book_id"
    )
    merged = state.merge_detail(watching, "known_missing", "title")
    bag = F.from_json("details", "known_missing string, note string")
    return merged.select(
        "book_id", "profile_slug", bag["known_missing"].alias("known_missing"), bag["note"].alias("note")
    )
