"""Record linkage over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions import similarity, text
from folioflux.operators import linkage, ordered, state
from folioflux.workload.ersql import CONFIDENCE
from folioflux.workload.filters import now
from folioflux.workload.registry import query

c = F.col


def queries_of(t) -> DataFrame:
    return t.watchlist.select(
        c("entry_id").alias("query_id"), "book_id", "title", F.trim("author").alias("author"),
        F.lit(None).cast("int").alias("year"),
        F.when(c("entry_id") % 9 == 0, c("entry_id").cast("string")).alias("identifier"),
    )


def candidates_of(t) -> DataFrame:
    """Search hits of the entries: the link log retold with spellings of every kind."""
    hits = t.link_log.join(t.book.select("book_id", c("title").alias("_t"), c("author").alias("_a")), "book_id")
    title = (
        F.when(c("seq") % 6 == 0, c("_t"))
        .when(c("seq") % 6 == 1, F.concat("_t", F.lit(" - Band "), c("seq") % 3))
        .when(c("seq") % 6 == 2, F.concat(F.lit("Der "), "_t", F.lit(": Roman")))
        .when(c("seq") % 6 == 3, F.concat("_t", F.lit(" und mehr")))
        .when(c("seq") % 6 == 4, F.regexp_replace("_t", "e", "ee"))
        .otherwise(F.concat("_t", F.lit(" / Roter Sand")))
    )
    author = (
        F.when(c("seq") % 4 == 0, c("_a")).when(c("seq") % 4 == 1, F.concat(F.lit("Dr. "), "_a"))
        .when(c("seq") % 4 == 2, F.lit("Kim Mannix"))
    )
    return hits.select(
        c("book_id").alias("query_id"), c("seq").alias("rank"), title.alias("title"),
        author.alias("author"), F.lit(None).cast("int").alias("year"),
        F.when(c("seq") % 9 == 0, c("book_id").cast("string")).alias("identifier"), "url",
    )


@query("fn_08_title_similarity", "SELECT query_id, c_rank AS rank, title_fuzzy AS score FROM er_scored")
def _(t):
    both = candidates_of(t).join(queries_of(t).select("query_id", c("title").alias("wanted")), "query_id")
    return both.select(
        "query_id", "rank",
        similarity.title_similarity(
            text.normalize_title(c("wanted")), text.normalize_title(c("title"))
        ).alias("score"),
    )


def _author_pairs(t) -> DataFrame:
    return candidates_of(t).select("query_id", "rank", c("author").alias("credited")).join(
        queries_of(t).select("query_id", c("author").alias("wanted")), "query_id"
    )


@query(
    "fn_09_author_scores",
    "SELECT query_id, c_rank AS rank, author_fuzzy AS fuzzy, author_strict AS strict FROM er_scored",
)
def _(t):
    scores = similarity.author_scores(
        text.normalize_authors(c("wanted")), text.normalize_authors(c("credited"))
    )
    return _author_pairs(t).withColumn("s", scores).select("query_id", "rank", "s.fuzzy", "s.strict")


@query("fn_10_author_match", "SELECT query_id, c_rank AS rank, author_strict >= 90 AS same_person FROM er_scored")
def _(t):
    from folioflux.sources.collect import author_matches

    return _author_pairs(t).select(
        "query_id", "rank", author_matches(c("wanted"), c("credited")).alias("same_person")
    )


@query("fn_11_author_conflict", "SELECT query_id, c_rank, author_conflict FROM er_scored")
def _(t):
    return linkage.scored_pairs(queries_of(t), candidates_of(t)).select(
        "query_id", "c_rank", "author_conflict"
    )


@query(
    "fn_12_title_contained",
    """WITH tok AS (SELECT title, list_filter(string_split(norm, ' '),
  lambda w: w NOT IN ('a','and','the','und','of','de') AND w <> '') AS t FROM title_norm)
SELECT o.id, len(a.t) > 0 AND len(b.t) > len(a.t)
  AND len(list_filter(a.t, lambda w: NOT list_contains(b.t, w))) = 0 AS contained
FROM obs o JOIN tok a ON a.title = o.title
JOIN (SELECT title, list_concat(t, ['roman']) AS t FROM tok) b ON b.title = o.title""",
)
def _(t):
    wanted = text.title_tokens(text.normalize_title(c("title")))
    longer = F.concat(wanted, F.array(F.lit("roman")))
    return t.obs.select("id", text.title_contained(wanted, longer).alias("contained"))


@query("er_01_candidate_scores", f"SELECT query_id, {', '.join(linkage.SCORED)} FROM er_scored")
def _(t):
    return linkage.scored_pairs(queries_of(t), candidates_of(t)).select(
        "query_id", *linkage.SCORED
    )


@query("er_02_rank_key", "SELECT query_id, c_rank, place FROM er_ranked")
def _(t):
    scored = linkage.scored_pairs(queries_of(t), candidates_of(t))
    ranked = scored.select("query_id", "c_rank", linkage.rank_key().alias("key"))
    by_key = Window.partitionBy("query_id").orderBy("key")
    return ranked.select("query_id", "c_rank", F.row_number().over(by_key).alias("place"))


@query("er_03_match_confidence", CONFIDENCE)
def _(t):
    return linkage.match(queries_of(t), candidates_of(t)).select(
        "query_id", "confidence", "reason", c("best.c_rank").alias("winner")
    )


@query("win_07_winner_and_runner_up", "SELECT query_id, c_rank AS winner, runner_up FROM er_two")
def _(t):
    two = linkage.best_two(linkage.scored_pairs(queries_of(t), candidates_of(t)), ["query_id"])
    return two.select(
        "query_id", c("best.c_rank").alias("winner"), c("second.c_rank").alias("runner_up")
    )


@query("er_04_ties", "SELECT query_id, is_tied AS tied FROM er_two")
def _(t):
    two = linkage.best_two(linkage.scored_pairs(queries_of(t), candidates_of(t)), ["query_id"])
    return two.select("query_id", linkage.tied(c("best"), c("second")).alias("tied"))


@query(
    "top_05_indistinguishable",
    """SELECT query_id, c_rank, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place
FROM er_tied WHERE tied QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 5""",
)
def _(t):
    scored = linkage.scored_pairs(queries_of(t), candidates_of(t))
    return linkage.indistinguishable(scored, ["query_id"]).select("query_id", "c_rank", "place")


def _items(t) -> DataFrame:
    """Finds to be linked to books: titles as a catalogue spells them."""
    return t.watchlist.select(
        c("entry_id").alias("item_id"),
        F.when(c("entry_id") % 4 == 0, F.concat(F.lit("978"), F.lpad(c("entry_id").cast("string"), 10, "0"))).alias("isbn"),
        # Some name works that no book has, twice each.
        F.when(c("entry_id") % 6 == 5, F.concat(F.lit("Unbekanntes Werk "), F.floor(c("entry_id") / 12)))
        .when(c("entry_id") % 5 == 1, F.concat("title", F.lit(" - Roman"))).otherwise(c("title")).alias("title"),
        F.when(c("entry_id") % 7 == 1, F.concat(F.lit("Dr. "), "author")).otherwise(c("author")).alias("author"),
        F.lit(None).cast("string").alias("series"),
    )


@query("er_05_find_book")
def _(t):
    return linkage.find_books(_items(t), t.book)


@query("er_06_find_or_create")
def _(t):
    assigned, _after = linkage.find_or_create(_items(t), t.book)
    return assigned


@query("er_06_books_after")
def _(t):
    _assigned, after = linkage.find_or_create(_items(t), t.book)
    return after


def _resolved(t):
    entries = queries_of(t).withColumn(
        "pinned", F.when(c("book_id") % 10 == 0, F.concat(F.lit("pin:"), "book_id"))
    )
    links = state.links(t.link_log.filter("source = 'click'")).filter("outcome <> 'unsure'")
    return linkage.resolve_entries(entries, links, candidates_of(t), now())


@query("er_07_resolved_entries")
def _(t):
    return _resolved(t)[0]


@query("er_07_attention")
def _(t):
    return _resolved(t)[1]


@query("er_08_book_of_entry")
def _(t):
    entries = t.watchlist.filter("active").select(
        c("entry_id").alias("item_id"), F.lit(None).cast("string").alias("isbn"), "title",
        "author", F.lit(None).cast("string").alias("series"),
    )
    return linkage.find_or_create(entries, t.book)[0]


@query(
    "er_09_learned_isbns",
    """SELECT book_id, isbn FROM (
  SELECT * FROM (SELECT o.id, o.book_id, o.isbn FROM obs o JOIN book b ON b.book_id = o.book_id
    WHERE b.isbn IS NULL AND o.isbn IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM book x WHERE x.isbn = o.isbn)
    QUALIFY row_number() OVER (PARTITION BY o.book_id ORDER BY id) = 1)
  QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY id) = 1)""",
)
def _(t):
    return linkage.learn_isbns(t.book, t.obs.select("id", "book_id", "isbn"))


_NUMBERS = """SELECT n.source, n.source_item_id, k.book_id, CASE WHEN k.book_id IS NOT NULL THEN 'known'
  WHEN NOT s.enabled THEN 'paused' WHEN s.enabled IS NULL THEN 'no source'
  WHEN i.source IS NULL THEN 'no item' ELSE 'new' END AS status
FROM (SELECT DISTINCT source, CAST(book_id % 300 AS varchar) AS source_item_id FROM link_log) n
LEFT JOIN (SELECT source, source_item_id, min(book_id) AS book_id FROM link
  WHERE source_item_id IS NOT NULL GROUP BY 1, 2) k USING (source, source_item_id)
LEFT JOIN (SELECT source, arg_max(enabled, seq) AS enabled FROM switch_log GROUP BY 1) s USING (source)
LEFT JOIN (SELECT DISTINCT source, source_item_id FROM obs) i USING (source, source_item_id)"""


def _numbers(t) -> DataFrame:
    numbers = t.link_log.select(
        "source", (c("book_id") % 300).cast("string").alias("source_item_id")
    ).distinct()
    switches = ordered.latest(t.switch_log, ["source"], "seq").select("source", "enabled")
    return linkage.resolve_numbers(
        numbers, state.links(t.link_log), switches, t.obs.select("source", "source_item_id")
    )


@query("er_10_old_dismissals", _NUMBERS)
def _(t):
    return _numbers(t).select("source", "source_item_id", "book_id", "status")


@query(
    "er_10_added_relations",
    f"""SELECT DISTINCT 'p0' AS profile_slug, n.book_id, k.kind FROM ({_NUMBERS}) n
CROSS JOIN (VALUES ('dismissed'), ('owned')) k(kind)
WHERE n.status = 'known' AND NOT EXISTS (SELECT 1 FROM relation_log r
  WHERE r.profile_slug = 'p0' AND r.book_id = n.book_id AND r.kind = k.kind)""",
)
def _(t):
    known = _numbers(t).filter("status = 'known'").withColumn("profile_slug", F.lit("p0"))
    return linkage.missing_relations(
        known, state.relations(t.relation_log), ["dismissed", "owned"]
    )


@query(
    "agg_17_resolution_report",
    f"SELECT status, count(*) AS n FROM ({_NUMBERS}) GROUP BY 1",
)
def _(t):
    return _numbers(t).groupBy("status").agg(F.count("*").alias("n"))
