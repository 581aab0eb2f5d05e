"""Sources, validation and sinks.

Answers of catalogues (JSON, XML, pages) are first derived from the tables, so the
values that a parser has to find are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.operators import changes, lookups, ordered, state
from folioflux.operators.changes import ITEM
from folioflux.sources import answers, catalogue_json, collect, marc, pages, records, sinks, validation
from folioflux.workload import sqltext as S
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col


# ------------------------------------------------------------------ validation


@query(
    "src_02_watchlist_ingest",
    """SELECT entry_id, trim(title) AS title, nullif(trim(author), '') AS author, active FROM watchlist""",
)
def _(t):
    return validation.watchlist_rows(t.watchlist).select("entry_id", "title", "author", "active")


@query(
    "src_02_duplicate_entries",
    """SELECT lower(trim(title) || '|' || coalesce(nullif(trim(author), ''), '')) AS entry_key, 'duplicate' AS violation
FROM watchlist GROUP BY 1 HAVING count(*) > 1""",
)
def _(t):
    return validation.watchlist_violations(validation.watchlist_rows(t.watchlist))


@query(
    "src_02_profile_violations",
    """SELECT c_custkey, CASE WHEN c_custkey % 700 - 3 <= 0 THEN 'strong_deal_max_cents not positive'
  WHEN c_nationkey * 40 <= 0 THEN 'deal_max_cents not positive'
  WHEN c_custkey % 11 = 0 THEN 'missing slug'
  WHEN c_custkey % 120 NOT BETWEEN 0 AND 99 THEN 'min_discount_pct not in 0..99'
  WHEN c_custkey % 8 NOT BETWEEN 0 AND 6 THEN 'sweep_weekday not in 0..6'
  WHEN c_custkey % 700 - 3 >= c_nationkey * 40 THEN 'strong not below deal' END AS violation FROM customer
WHERE violation IS NOT NULL""",
)
def _(t):
    profiles = t.customer.selectExpr(
        "c_custkey",
        "cast(c_custkey % 700 - 3 as int) as strong_deal_max_cents",
        "c_nationkey * 40 as deal_max_cents",
        "case when c_custkey % 11 <> 0 then c_name else '' end as slug",
        "c_custkey % 120 as min_discount_pct",
        "c_custkey % 8 as sweep_weekday",
    )
    return validation.profile_violations(profiles).select("c_custkey", "violation")


@query(
    "src_02_owned_violations",
    """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'missing title' ELSE 'stars not in 0..5' END AS violation
FROM part WHERE p_size % 9 = 0 OR p_size % 8 > 5""",
)
def _(t):
    owned = t.part.selectExpr(
        "p_partkey", "case when p_size % 9 = 0 then ' ' else p_name end as title", "p_size % 8 as stars"
    )
    return validation.owned_violations(owned).select("p_partkey", "violation")


# --------------------------------------------------------------------- sources


@query(
    "src_03_canned_items",
    """SELECT i.p_partkey, coalesce(i.reason, 'watchlist') AS match_reason, e.watchlist_key, e.book_id
FROM (SELECT p_partkey, p_name || ' ' || p_size % 7 AS title, CASE WHEN p_size % 2 = 0 THEN 'genre_category' END AS reason FROM part) i
LEFT JOIN (SELECT lower(title) AS t, arg_max(book_id, entry_id) AS book_id,
    arg_max(lower(title || '|' || coalesce(author, '')), entry_id) AS watchlist_key
  FROM watchlist WHERE active GROUP BY 1) e ON e.t = lower(i.title)""",
)
def _(t):
    items = t.part.selectExpr(
        "p_partkey", "concat(upper(p_name), ' ', p_size % 7) as title",
        "case when p_size % 2 = 0 then 'genre_category' end as match_reason",
    )
    return collect.canned(items, t.watchlist).select(
        "p_partkey", "match_reason", "watchlist_key", "book_id"
    )


def _json_items(t) -> DataFrame:
    item = F.struct(
        c("p_partkey").cast("string").alias("id"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"),
        F.when(c("p_size") % 5 > 0, c("p_brand")).otherwise("  ").alias("firstCreatorName"),
        F.when(c("p_size") % 6 > 0, c("p_size") % 4).alias("ownedCopies"),
        (c("p_size") % 3).alias("availableCopies"),
        c("p_size").alias("holdsCount"),
        F.array(
            F.struct(F.lit(None).cast("string").alias("isbn")),
            F.struct(F.concat(F.lit("978-"), F.lpad(c("p_partkey").cast("string"), 10, "0")).alias("isbn")),
        ).alias("formats"),
        F.struct(F.struct(F.concat(F.lit("https://i/"), "p_partkey").alias("href")).alias("cover300Wide"))
        .alias("covers"),
        c("p_type").alias("description"),
    )
    return t.part.select("p_partkey", "p_size", item.alias("item"))


@query(
    "src_04_json_titles",
    """SELECT p_partkey, trim(p_name) AS title, CASE WHEN p_size % 5 > 0 THEN p_brand END AS author,
  '978' || lpad(CAST(p_partkey AS varchar), 10, '0') AS isbn, p_size AS reservation_count,
  CASE WHEN p_size % 4 <= 0 THEN 'unknown' WHEN p_size % 3 > 0 THEN 'available' ELSE 'unavailable' END AS availability,
  'https://i/' || p_partkey AS cover_url FROM part WHERE p_size % 6 > 0""",
)
def _(t):
    answers = _json_items(t).select("p_partkey", F.to_json("item").alias("value"))
    return catalogue_json.title_records(answers)[0].select(
        "p_partkey", "title", "author", "isbn", "reservation_count", "availability", "cover_url"
    )


@query(
    "src_04_json_quarantine",
    "SELECT p_partkey, 'no ownedCopies' AS error FROM part WHERE p_size % 6 = 0",
)
def _(t):
    answers = _json_items(t).select("p_partkey", F.to_json("item").alias("value"))
    return catalogue_json.title_records(answers)[1].select("p_partkey", "error")


@query(
    "src_05_json_search",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'hits' WHEN 1 THEN 'none' ELSE 'error' END AS status,
  r.rank, CASE WHEN p_size % 3 = 0 THEN p_name END AS title,
  CASE WHEN p_size % 3 = 0 THEN '978' || lpad(CAST(p_partkey AS varchar), 10, '0') END AS isbn
FROM part JOIN (VALUES (0), (1), (NULL)) r(rank)
  ON (p_size % 3 = 0 AND r.rank IS NOT NULL) OR (p_size % 3 > 0 AND r.rank IS NULL)""",
)
def _(t):
    rows = _json_items(t)
    found = F.to_json(F.struct(F.array("item", "item").alias("items")))
    value = F.when(c("p_size") % 3 == 0, found).when(c("p_size") % 3 == 1, '{"items":[]}').otherwise('{"x":1}')
    return catalogue_json.search_results(rows.select("p_partkey", value.alias("value"))).select(
        "p_partkey", "status", "rank", "title", "isbn"
    )


def _parts(t) -> int:
    cores = t.spark.sparkContext.defaultParallelism
    return max(3 * cores, int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def _dealt(t) -> DataFrame:
    """The log dealt out to all cores: it may come as one part, and its pages cost more than its rows."""
    return t.obs.repartition(_parts(t))


def _listing_pages(t) -> DataFrame:
    """One page per find with two boxes of one order number and one other box."""
    def box(order, title_attr, text, number):
        return F.concat(
            F.lit('<div class="product--box box--list" data-ordernumber="'), order, F.lit('">'),
            F.lit('<a class="product--title" href="/x/'), number, F.lit('/'), F.lit('t?c=1" title="'), title_attr,
            F.lit('">'), text, F.lit(' <span class="product--subtitle">Roman</span></a>'),
            F.coalesce(
                F.concat(F.lit('<a class="product--author" href="/a">von '), "author", F.lit("</a>")),
                F.lit(""),
            ),
            F.lit('<span class="price--default">'),
            F.coalesce(F.replace(F.format_string("%.2f", c("price_cents") / 100), F.lit("."), F.lit(",")), F.lit("k. A.")),
            F.lit(' €</span><span class="product--badge">NEU</span><br></div>'),
        )

    order = F.concat(F.lit("SW"), F.coalesce("isbn", F.lit("123")), F.lit("110"))
    item = c("source_item_id")
    html = F.concat(
        F.lit('<html><body><div class="listing" data-pages="3"><script>var x = "<p>";</script>'),
        box(order, c("title"), F.lit("abc"), item),
        box(order, F.lit("zweite"), F.lit("abc"), item),
        box(F.concat(F.lit("B"), "id"), F.lit(""), c("title"), item),
        # A box without title and link voids the page, good boxes and all.
        F.when(c("id") % 20 == 2, '<div class="product--box" data-ordernumber="Z"></div>').otherwise(""),
        F.lit("</div></body></html>"),
    )
    empty = F.when(c("id") % 20 == 0, "<p>keine Artikel gefunden</p>").when(
        c("id") % 20 == 1, "<p>umgebaut</p>"
    )
    return _dealt(t).select(c("id").alias("page_id"), F.coalesce(empty, html).alias("html"))


@query(
    "src_06_listing_tiles",
    """SELECT id AS page_id, order_number, title || extra AS title, author, price_cents, isbn,
  'https://shop.example/x/' || source_item_id || '/t' AS url, source_item_id AS product_id FROM (
  SELECT *, 'SW' || coalesce(isbn, '123') || '110' AS order_number, '' AS extra FROM obs
  UNION ALL SELECT * REPLACE (NULL AS isbn), 'B' || id, ' Roman' FROM obs) WHERE id % 20 > 2""",
)
def _(t):
    good, _ = pages.listing_tiles(_listing_pages(t), base="https://shop.example/romane/seite-1")
    return good.select(
        "page_id", "order_number", "title", "author", "price_cents", "isbn", "url", "product_id"
    )


@query(
    "src_06_listing_errors",
    """SELECT id AS page_id, CASE id % 20 WHEN 1 THEN 'no tiles and no empty answer'
  ELSE 'tile without title, link or id' END AS error FROM obs WHERE id % 20 IN (1, 2)""",
)
def _(t):
    return pages.listing_tiles(_listing_pages(t))[1]


@query(
    "src_06_page_count",
    "SELECT id AS page_id, CASE WHEN id % 20 > 1 THEN 3 END AS total_pages FROM obs",
)
def _(t):
    return pages.page_counts(_listing_pages(t))


@query("src_06_links_of_pages")
def _(t):
    return pages.page_links(t.pages)


@query(
    "src_07_product_details",
    """SELECT id AS page_id, price_cents, isbn, author, 'https://s.example/d/' || source_item_id AS url,
  CASE WHEN id % 2 = 0 THEN 'Ganzer Text ' || id ELSE 'Anriss' END AS blurb FROM obs WHERE price_cents IS NOT NULL""",
)
def _(t):
    text = F.when(
        c("id") % 2 == 0,
        F.concat(F.lit('<div class="description--full">Ganzer <b>Text</b> '), "id", F.lit("</div>")),
    ).otherwise('<div class="description--full"> </div>')
    html = F.concat(
        F.lit('<head><link rel="canonical" href="https://s.example/d/'), "source_item_id",
        F.lit('?x=1"></head><div class="product--details"><meta itemprop="price" content="'),
        F.coalesce(F.format_string("%.2f", c("price_cents") / 100), F.lit("?")),
        F.lit('"><input name="sAdd" value="SW'), F.coalesce("isbn", F.lit("0")),
        F.lit('110"><a href="?saltFieldLimitation=author">'), F.coalesce("author", F.lit("")),
        F.lit('</a></div><div itemprop="description"><div class="description--preview">Anriss</div>'),
        text, F.lit("</div>"),
    )
    good, _ = pages.product_details(_dealt(t).select(c("id").alias("page_id"), html.alias("html")))
    return good.select("page_id", "price_cents", "isbn", "author", "url", "blurb")


@query(
    "src_08_library_details",
    """SELECT id AS page_id, reservation_count AS copies, CAST(source_item_id AS INT) % 2 AS available_copies,
  CASE WHEN source_item_id::INT % 2 >= 1 THEN 'available' ELSE 'unavailable' END AS availability,
  author, isbn, strftime(observed_at, '%d.%m.%Y') AS available_from,
  CASE WHEN rating IS NOT NULL THEN rating END AS rating, rating_votes AS votes, title AS blurb
FROM obs WHERE reservation_count > 0""",
)
def _(t):
    def row(label, value):
        return F.concat(
            F.lit('<p class="horizontalDescription"><b>'), F.lit(label), F.lit("</b><span>"), value,
            F.lit(" ;</span></p>"),
        )

    stars = F.coalesce(
        F.concat(F.repeat(F.lit('<i class="ic_star active"></i>'), c("rating")),
                 F.repeat(F.lit('<i class="ic_star"></i>'), 5 - c("rating"))),
        F.lit(""),
    )
    html = F.concat(
        F.when(
            c("reservation_count") > 0,
            F.concat(F.lit('<span class="exemplar-count">Exemplare: '), "reservation_count", F.lit("</span>")),
        ).otherwise(""),
        F.lit('<span class="availability-count">'), c("source_item_id").cast("int") % 2, F.lit("</span>"),
        F.when(c("author").isNotNull(), row("Autor*in:", c("author"))).otherwise(""),
        F.when(c("isbn").isNotNull(), row("ISBN:", c("isbn"))).otherwise(""),
        row("Voraussichtlich verfügbar ab:", F.date_format("observed_at", "dd.MM.yyyy")),
        stars, F.lit('<dl><dt class="user-vote">Stimmen</dt><dd>'), "rating_votes",
        F.lit(' Stimmen</dd><dt class="abstract">Inhalt</dt><dd>'), "title", F.lit("</dd></dl>"),
    )
    good, _ = pages.library_details(_dealt(t).select(c("id").alias("page_id"), html.alias("html")))
    return good.select(
        "page_id", "copies", "available_copies", "availability", "author", "isbn",
        "available_from", "rating", "votes", "blurb",
    )


def _cards(t) -> DataFrame:
    card = F.concat(
        F.lit('<div test-id="mediaCard"><h3 test-id="cardTitle">'), "title",
        F.lit('</h3><span test-id="cardAuthor">'), F.coalesce("author", F.lit("")),
        F.lit('</span><svg test-id="ic_ebook"></svg><a test-id="mediaInfoLink" href="mediaInfo,0-0-'),
        "source_item_id", F.lit('-200.html">mehr</a></div>'),
    )
    html = (
        F.when(c("id") % 10 == 0, "<p>keine Titeltreffer</p>")
        .when(c("id") % 10 == 1, F.concat(F.lit("<p>Ihre Sitzung ist abgelaufen</p>"), card))
        .otherwise(F.concat(F.lit("<p>12 Titeltreffer</p>"), card, card))
    )
    return _dealt(t).select(c("id").alias("page_id"), html.alias("html"))


@query(
    "src_09_result_cards",
    """SELECT id AS page_id, title, author, 'ic_ebook' AS medium, 'mediaInfo,0-0-' || source_item_id || '-200.html' AS url
FROM obs, (VALUES (1), (2)) v(n) WHERE id % 10 > 1""",
)
def _(t):
    return pages.result_cards(_cards(t))[0].select("page_id", "title", "author", "medium", "url")


@query(
    "src_09_hits_and_errors",
    """SELECT id AS page_id, CASE id % 10 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 12 END AS total_hits,
  CASE WHEN id % 10 = 1 THEN 'session expired' END AS error FROM obs""",
)
def _(t):
    return pages.hits_and_errors(_cards(t))


def _marc(t) -> DataFrame:
    # Answers are many times the bytes they are made from: as many parts as cores, however small.
    volumes = t.contains.repartition(_parts(t), "isbn").groupBy("isbn").agg(
        F.array_sort(F.collect_set("contained")).alias("v")
    )
    sub = lambda code, value: F.concat(F.lit(f'<subfield code="{code}">'), value, F.lit("</subfield>"))
    tag = lambda n, inner: F.concat(F.lit(f'<datafield tag="{n}" ind1=" ">'), inner, F.lit("</datafield>"))
    edges = lambda some: F.array_join(
        F.transform(some, lambda x: tag("770", F.concat(sub("i", F.lit("Enthält")), sub("z", x), sub("z", F.lit("bad"))))), ""
    )
    xml = F.concat(
        F.lit('<searchRetrieveResponse xmlns="http://www.loc.gov/zing/srw/"><numberOfRecords>'),
        F.when(c("isbn").endswith("7"), "0").otherwise("1"),
        F.lit('</numberOfRecords><records><record><recordData><record xmlns="http://www.loc.gov/MARC21/slim">'),
        tag("041", sub("a", F.lit("ger"))),
        tag("245", F.concat(sub("a", F.concat(F.lit("&#152;Der&#156; Titel "), "isbn")), sub("c", F.lit("Credit")))),
        tag("490", F.concat(sub("a", F.lit("Reihe")), sub("v", F.lit("3")))),
        # The volumes are spread over two records of one answer.
        edges(F.slice("v", 1, 1)),
        F.lit("</record></recordData></record><record><recordData><record>"),
        tag("245", sub("a", F.lit("Zweiter Satz"))),
        edges(F.slice("v", 2, 1000)),
        F.lit("</record></recordData></record></records></searchRetrieveResponse>"),
    )
    return volumes.select("isbn", xml.alias("xml"))


@query(
    "src_10_marc_records",
    """SELECT isbn, NOT isbn LIKE '%7' AS found, CASE WHEN isbn NOT LIKE '%7' THEN 'Der Titel ' || isbn END AS title,
  CASE WHEN isbn NOT LIKE '%7' THEN 'Credit' END AS author, CASE WHEN isbn NOT LIKE '%7' THEN '3' END AS series_index
FROM (SELECT DISTINCT isbn FROM contains)""",
)
def _(t):
    return marc.records(_marc(t))[0].select("isbn", "found", "title", "author", "series_index")


@query(
    "src_10_marc_edges",
    "SELECT isbn, contained FROM contains WHERE isbn NOT LIKE '%7'",
)
def _(t):
    return marc.records(_marc(t))[1]


_WANTED = """SELECT DISTINCT source, source_item_id, author AS credited FROM obs
WHERE author IS NOT NULL"""


@query(
    "src_11_author_listings",
    f"""SELECT w.wanted AS author, o.source, o.source_item_id
FROM (VALUES ('Frank Schätzing', 'frank schatzing'), ('Jo Nesbo', 'jo nesbo')) w(wanted, full_name)
JOIN author_norm a ON a.full_name = w.full_name JOIN ({_WANTED}) o ON o.credited = a.author
UNION ALL SELECT 'Chris Carter', source, source_item_id FROM ({_WANTED}) WHERE source = 'click'
GROUP BY ALL""",
)
def _(t):
    obs = t.obs.filter("author is not null").select(
        "source", "source_item_id", c("author").alias("credited"), c("id").alias("rank")
    )
    names = ("Frank Schätzing", "Jo Nesbo", "Chris Carter")
    # Every find answers the search for every name; the match decides.
    search = obs.withColumn(
        "author", F.explode(F.array(*[F.when(c("rank") >= 0, x) for x in names]))
    )
    hub = obs.filter("source = 'click'").withColumn("author", F.lit("Chris Carter"))
    return collect.by_author(hub, search).select("author", "source", "source_item_id")


@query(
    "src_12_shop_collection",
    f"""SELECT {S.ITEM}, run_id, id FROM (
  SELECT {S.ITEM}, run_id, arg_min(id, (CASE match_reason WHEN 'watchlist' THEN 0
    WHEN 'profile_author' THEN 1 ELSE 2 END, id)) AS id, arg_min(coalesce(isbn, ''), (CASE match_reason
    WHEN 'watchlist' THEN 0 WHEN 'profile_author' THEN 1 ELSE 2 END, id)) AS isbn FROM obs
  WHERE source NOT IN ('view', 'signup') GROUP BY ALL) o
WHERE NOT EXISTS (SELECT 1 FROM link l JOIN relation r USING (book_id)
    WHERE r.active AND r.kind = 'dismissed' AND r.profile_slug = o.profile_slug
      AND l.source = o.source AND l.source_item_id = o.source_item_id)
  AND NOT EXISTS (SELECT 1 FROM book b JOIN relation r USING (book_id)
    WHERE r.active AND r.kind = 'dismissed' AND r.profile_slug = o.profile_slug AND b.isbn = o.isbn)""",
)
def _(t):
    from folioflux.config import source_kind

    finds = t.obs.filter(source_kind(PROFILE, c("source")) == "shop").select(
        *ITEM, "run_id", "match_reason", "id", "isbn"
    )
    items, isbns = lookups.dismissed_keys(
        state.links(t.link_log), t.book, state.relations(t.relation_log)
    )
    claimed = collect.first_claim(finds)
    return lookups.not_covered(claimed, items, isbns).select(*ITEM, "run_id", "id")


@query(
    "join_20_swept_interests",
    """SELECT DISTINCT i.profile_slug, i.interest_id, s.source
FROM (SELECT profile_slug, min(seq) AS interest_id, arg_max(active, seq) AS active FROM interest_log
  GROUP BY profile_slug, interest_key, value) i
JOIN (SELECT DISTINCT profile_slug, source FROM obs) s USING (profile_slug) WHERE i.active""",
)
def _(t):
    wanted = state.interests(t.interest_log).filter("active")
    return collect.swept(wanted, t.obs.select("profile_slug", "source").distinct())


def search_hits(t) -> DataFrame:
    """What each search brought, under the interest that it was made for."""
    asked = t.interest_log.select(c("seq").alias("search"), "interest_key", "value")
    return t.search_hit.join(asked, "search").select(
        *ITEM, "interest_key", "value", c("seq").alias("id")
    )


@query(
    "join_20_origin_of_finds",
    "SELECT profile_slug, source, source_item_id, interest_id, claimed_as, found_by FROM origin",
)
def _(t):
    return collect.origins(t.obs, search_hits(t), state.interests(t.interest_log))


@query(
    "src_13_library_checks",
    f"""SELECT e.profile_slug, e.book_id, l.source, o.id FROM entry e JOIN link l USING (book_id)
JOIN obs_latest o ON o.profile_slug = e.profile_slug AND o.source = l.source AND o.source_item_id = l.source_item_id
WHERE e.active AND l.source IN ('view', 'signup') AND coalesce(e.restriction = 'library', TRUE)""",
)
def _(t):
    from folioflux.workload.filters import _entries

    latest = ordered.latest(t.obs.select(*ITEM, "id"), ITEM)
    return collect.library_checks(
        _entries(t), state.links(t.link_log), latest, PROFILE
    ).select("profile_slug", "book_id", "source", "id")


@query(
    "src_14_all_sources",
    """SELECT source, count(*) AS n, count(error) AS failures FROM (
  SELECT source, NULL AS error FROM obs UNION ALL
  SELECT source, error FROM probe_log WHERE NOT ok) GROUP BY 1""",
)
def _(t):
    failures = t.probe_log.filter("not ok").select("source", "error")
    both = validation.union_all([t.obs.select("id", "source"), failures])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("error").alias("failures"))


def _answers(t) -> tuple[DataFrame, DataFrame]:
    """Two catalogues that answer and one that is gone."""
    return answers.collect(t.spark, {
        "kunden": (f"{t.sf_dir}/customer.parquet", {
            "source_item_id": "c_custkey", "title": "c_name", "blurb": "c_mktsegment"}),
        "katalog": (f"{t.sf_dir}/part.parquet", {
            "source_item_id": "p_partkey", "title": "p_name", "author": "p_brand", "blurb": "p_type"}),
        "weg": (f"{t.sf_dir}/gone.parquet", {"title": "title"}),
    })


@query(
    "src_14_collected_items",
    """SELECT 'kunden' AS source, CAST(c_custkey AS varchar) AS source_item_id, c_name AS title, NULL AS author, c_mktsegment AS blurb FROM customer
UNION ALL SELECT 'katalog', CAST(p_partkey AS varchar), p_name, p_brand, p_type FROM part""",
)
def _(t):
    return _answers(t)[0].select("source", "source_item_id", "title", "author", "blurb")


@query(
    "src_14_collected_report",
    """SELECT source, count(*) FILTER (NOT bad) AS items, count(*) FILTER (bad) AS failures FROM (
  SELECT 'kunden' AS source, FALSE AS bad FROM customer UNION ALL SELECT 'katalog', FALSE FROM part
  UNION ALL SELECT 'weg', TRUE) GROUP BY 1""",
)
def _(t):
    items, failures = _answers(t)
    return items.select("source", F.lit(None).alias("message")).unionByName(failures).groupBy("source").agg(
        F.count_if(F.col("message").isNull()).alias("items"), F.count("message").alias("failures")
    )


@query(
    "src_16_item_lookup",
    """SELECT n.source, n.source_item_id, i.title FROM (SELECT DISTINCT source, CAST(book_id % 300 AS varchar) AS source_item_id FROM link_log) n
LEFT JOIN (SELECT source, source_item_id, arg_max(title, id) AS title FROM obs GROUP BY 1, 2) i USING (source, source_item_id)""",
)
def _(t):
    numbers = t.link_log.select(
        "source", (c("book_id") % 300).cast("string").alias("source_item_id")
    ).distinct()
    items = t.obs.groupBy("source", "source_item_id").agg(F.max_by("title", "id").alias("title"))
    return numbers.join(items, ["source", "source_item_id"], "left")


# ----------------------------------------------------------------------- sinks


@query(
    "snk_01_appended_rows",
    """SELECT id, CASE WHEN book_id IS NULL THEN blurb END AS blurb,
  CASE WHEN id % 5 = 0 THEN TIMESTAMP '2001-08-01 03:00:00' ELSE observed_at END AS observed_at FROM obs""",
)
def _(t):
    from folioflux.workload.filters import now

    timeless = t.obs.withColumn("observed_at", F.when(c("id") % 5 != 0, c("observed_at")))
    return sinks.observation_rows(timeless, now()).select("id", "blurb", "observed_at")


@query(
    "snk_02_remembered_blurbs",
    """SELECT b.book_id, CASE WHEN length(n.blurb) > length(coalesce(b.blurb, '')) THEN n.blurb ELSE b.blurb END AS blurb
FROM book b LEFT JOIN (SELECT book_id, blurb FROM obs WHERE book_id IS NOT NULL AND length(blurb) > 0
  QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY length(blurb) DESC, id) = 1) n USING (book_id)""",
)
def _(t):
    return sinks.remembered_blurbs(t.book.select("book_id", "blurb"), t.obs)


@query(
    "snk_03_foreign_ratings",
    f"""SELECT subject, CAST(rating AS DOUBLE) AS stars, 'Durchschnitt der Leser:innen aus ' || rating_votes || ' Stimmen' AS reason
FROM (SELECT *, {S.SUBJECT} AS subject FROM obs WHERE rating IS NOT NULL AND rating_votes > 0
  QUALIFY row_number() OVER (PARTITION BY {S.SUBJECT} ORDER BY id DESC) = 1)""",
)
def _(t):
    return sinks.foreign_ratings(t.obs).select("subject", "stars", "reason")


@query(
    "snk_04_record_cache",
    """SELECT isbn, arg_max(found, seq) AS found, arg_max(title, seq) FILTER (found) AS title FROM (
  SELECT o_orderkey AS seq, 'i' || o_custkey AS isbn, o_orderstatus <> 'F' AS found,
    CASE WHEN o_orderstatus <> 'F' THEN 't' || o_orderkey END AS title FROM orders) GROUP BY 1""",
)
def _(t):
    answers = t.orders.selectExpr(
        "o_orderkey as seq", "concat('i', o_custkey) as isbn", "o_orderstatus <> 'F' as found",
        "case when o_orderstatus <> 'F' then concat('t', o_orderkey) end as title",
        "o_orderdate as checked_at",
    )
    return records.record_cache(answers).select("isbn", "found", "title")


@query("snk_04_record_edges", "SELECT isbn, contained FROM contains")
def _(t):
    return records.record_edges(t.contains)


_DIGEST = f"""
SELECT section_rank, id, title, detail, flag FROM (
  SELECT CASE WHEN kind = 'became_available' THEN 1 WHEN match_reason = 'watchlist' THEN 2
      WHEN match_reason = 'profile_author' THEN 3 ELSE 4 END AS section_rank, id, title,
    CASE kind WHEN 'became_available' THEN 'jetzt verfügbar' ||
        CASE WHEN prev_res > 0 THEN ' (zuvor ' || prev_res || ' Vormerkungen)' ELSE '' END
      WHEN 'first_seen' THEN saving || CASE match_reason WHEN 'watchlist' THEN 'steht auf deiner Watchlist'
        WHEN 'profile_author' THEN coalesce('neu von ' || author || ', der du folgst', 'neu von einer Autor:in, der du folgst')
        ELSE coalesce('neu im Thema ' || {S.THEME}, 'neu in einem Thema, dem du folgst') END
        || coalesce(' · ' || {S.money('price_cents')}, '')
      ELSE saving || {S.money('prev_price')} || ' → ' || {S.money('price_cents')} END AS detail,
    CASE WHEN kind <> 'became_available' THEN CASE WHEN price_cents > 0 AND price_cents < 500 THEN 'Strong Deal'
      WHEN price_cents >= 500 AND price_cents < 1000 AND (coalesce(original_price_cents > price_cents
        AND (original_price_cents - price_cents) * 100.0 / original_price_cents >= 25, FALSE)
        OR coalesce(prev_price > price_cents AND (prev_price - price_cents) * 100.0 / prev_price >= 25, FALSE)) THEN 'Deal' END END AS flag
  FROM (SELECT d.*, coalesce(replace(printf('%d Bände für %.2f € statt %.2f € — %d %% gespart', a.volumes,
      d.price_cents / 100.0, a.singles / 100.0, a.saved_pct), '.', ',') || ' · ', '') AS saving
    FROM delta d LEFT JOIN advantages a USING (id)) x
  UNION ALL SELECT 5, l.seq, b.title, l.source || ': unklar' || coalesce(' — bester Treffer: „' || l.matched_title || '“', ''), NULL
  FROM link l JOIN book b USING (book_id) WHERE outcome = 'unsure'
  UNION ALL SELECT 6, seq, source, error, NULL FROM probe_log WHERE NOT ok)"""


def attention_of(t) -> DataFrame:
    """Open questions of the links, and what was the best guess."""
    return state.links(t.link_log).filter("outcome = 'unsure'").join(
        t.book.select("book_id", c("title").alias("entry_title"), c("author").alias("entry_author")), "book_id"
    ).select(
        c("seq").alias("id"), "source", "entry_title", "entry_author", F.lit("unklar").alias("reason"),
        c("matched_title").alias("best_guess"), c("url").alias("best_guess_url"),
    )


def failures_of(t) -> DataFrame:
    return t.probe_log.filter("not ok").select(
        c("seq").alias("id"), "source", c("error").alias("message")
    )


def digest_of(t) -> DataFrame:
    from folioflux.workload.changes import compared, with_advantage

    compared_rows = compared(t)
    plain = changes.notifiable(changes.changes(compared_rows, PROFILE))
    found = with_advantage(t, t.obs).filter("advantage is not null").select("id", "advantage")
    deltas = plain.join(found, "id", "left")
    return sinks.digest(deltas, attention_of(t), failures_of(t), PROFILE)


@query("snk_05_digest", _DIGEST)
def _(t):
    return digest_of(t).select("section_rank", "id", "title", "detail", "flag")


@query(
    "top_07_digest_order",
    f"""SELECT section_rank, count(*) AS entries FROM ({_DIGEST}) GROUP BY 1 ORDER BY 1""",
)
def _(t):
    return digest_of(t).groupBy("section_rank").agg(F.count("*").alias("entries")).orderBy("section_rank")
