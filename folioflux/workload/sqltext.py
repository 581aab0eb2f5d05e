"""SQL-side forms of the text rules, written for DuckDB's engine (RE2 patterns)."""

import re

FOLDS = [("ß", "ss"), ("ẞ", "ss"), ("ø", "o"), ("Ø", "o"), ("æ", "ae"), ("œ", "oe")]


def fold(column: str) -> str:
    text = column
    for a, b in FOLDS:
        text = f"replace({text}, '{a}', '{b}')"
    return f"lower(strip_accents({text}))"


ARTICLES = (
    "the|a|an|of|and|der|die|das|den|dem|des|ein|eine|einen|einem|einer|le|la|les|el|los|il"
)
FORMATS = (
    "'ebook','e-book','horbuch','audiobook','ungekurzt','gekurzt','omnibus','unabridged',"
    "'abridged','taschenbuch','gebundene'"
)
BUNDLE = (
    r"(?i)sammelband|sammelausgabe|gesamtausgabe|gesamtwerk|\bbundle\b|\d\s*in\s*1"
    r"|^\s*\d+\s+[\pL\pN_]+([-\s][\pL\pN_]+)?\s*:"
    r"|^\s*(zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|zwölf)(mal|f?\s)"
)
EPISODE = r"(?i)\b(episode|folge)\s*\d+"

def titles(source: str) -> str:
    """Comparable forms of the titles of a query."""
    return f"""
SELECT title, folded, list_aggregate(list_filter(
    string_split(regexp_replace(trim(regexp_replace(
      regexp_replace(cut, '[:,;!@$%^&*(){{}}.`~"\\[\\]/–—]', ' ', 'g'), '\\s+', ' ', 'g')),
      '^((?:{ARTICLES})\\s+)+', ''), ' '),
    lambda w: w <> '' AND w NOT IN ({FORMATS})), 'string_agg', ' ') AS norm
FROM (
  SELECT title, folded,
    CASE WHEN length(trim(head)) > 1 THEN head ELSE bare END AS cut
  FROM (
    SELECT title, folded, bare,
      string_split_regex(bare, '\\s[-–—]\\s|:\\s|\\s/\\s|\\s\\\\\\s')[1] AS head
    FROM (
      SELECT title, folded, regexp_replace(regexp_replace(regexp_replace(folded,
          '[({{\\[]\\s*(\\d{{4}}|omnibus|ebook|edition|auflage|ungekurzt|gekurzt)\\s*[\\])}}]', ' ', 'g'),
          '[({{\\[][^\\])}}]*?(edition|ed\\.|auflage)[^\\])}}]*?[\\])}}]', ' ', 'g'),
          '([(\\[][^)\\]]*[)\\]]\\s*){{1,2}}$', ' ') AS bare
      FROM (SELECT DISTINCT title, {fold('title')} AS folded FROM ({source}) x)
    )
  )
)"""


TITLES = titles("SELECT title FROM obs UNION ALL SELECT title FROM book UNION ALL SELECT title FROM watchlist")

AUTHORS = f"""
SELECT author, full_name FROM (
  SELECT author, trim(regexp_replace(CASE WHEN contains(f, ',')
      THEN trim(split_part(f, ',', 2)) || ' ' || trim(split_part(f, ',', 1)) ELSE f END,
      '[-+.:;,!@#$%^&*()/\\s]+', ' ', 'g')) AS full_name
  FROM (SELECT DISTINCT author, {fold('author')} AS f FROM (
    SELECT author FROM obs UNION ALL SELECT author FROM book) x
    WHERE author IS NOT NULL)
)"""

SLASH = r"\s+/\s+"


def volumes(column: str) -> str:
    """Titles of the slash form, or an empty list."""
    parts = (
        f"list_transform(string_split_regex(regexp_replace({column}, "
        rf"'^\s*\d+\s+[\pL\pN_]+([-\s][\pL\pN_]+)?\s*:\s*', ''), '\s+/\s+'), lambda p: trim(p))"
    )
    return (
        f"CASE WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda p: length(p) < 3)) = 0 "
        f"THEN {parts} ELSE [] END"
    )


def looks_like_bundle(column: str) -> str:
    return f"(regexp_matches({column}, '{BUNDLE}') OR len({volumes(column)}) >= 2)"


def junk(price: str = "price_cents", reason: str = "match_reason", title: str = "title") -> str:
    return (
        f"CASE WHEN {price} = 0 THEN 'gratis' WHEN {reason} = 'genre_category' THEN "
        f"CASE WHEN regexp_matches({title}, '{BUNDLE}') THEN 'Sammelband' "
        f"WHEN regexp_matches({title}, '{EPISODE}') THEN 'Fortsetzungsheft' END END"
    )


def announce(extra: str = "FALSE", p: str = "") -> str:
    return (
        f"CASE WHEN {p}match_reason = 'watchlist' THEN TRUE "
        f"WHEN {junk(p + 'price_cents', p + 'match_reason', p + 'title')} IS NOT NULL THEN FALSE "
        f"ELSE coalesce({p}availability = 'available', FALSE) OR {extra} "
        f"OR coalesce({p}price_cents > 0 AND {p}price_cents < 500, FALSE) END"
    )


THEME = (
    "CASE regexp_extract(trim(category, '/'), '[^/]*$') "
    "WHEN 'psychothriller' THEN 'Psychothriller' WHEN 'space-opera' THEN 'Space Opera' "
    "ELSE upper(substr(replace(regexp_extract(trim(category, '/'), '[^/]*$'), '-', ' '), 1, 1)) || "
    "lower(substr(replace(regexp_extract(trim(category, '/'), '[^/]*$'), '-', ' '), 2)) END"
)


def money(column: str) -> str:
    return f"replace(printf('%.2f €', {column} / 100.0), '.', ',')"


SUBJECT = (
    "CASE WHEN length(isbn) > 0 THEN 'isbn:' || isbn "
    "ELSE 'item:' || source || ':' || source_item_id END"
)
ITEM = "profile_slug, source, source_item_id"
SQL_VIEWS = {
    "title_norm": TITLES,
    "author_norm": AUTHORS,
    # Last state of an item in each run, and every row with the state before its run.
    "run_state": f"""SELECT {ITEM}, run_id, arg_max(price_cents, id) AS p0, max(id) AS last_id
FROM obs GROUP BY ALL""",
    "obs_prev": """SELECT o.*, b.id AS prev_id, b.price_cents AS prev_price,
  b.availability AS prev_av, b.reservation_count AS prev_res
FROM obs o ASOF LEFT JOIN run_state s ON o.profile_slug = s.profile_slug AND o.source = s.source
  AND o.source_item_id = s.source_item_id AND o.run_id > s.run_id
LEFT JOIN obs b ON b.id = s.last_id""",
    "obs_latest": f"SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY id DESC) = 1",
    "finds": f"""SELECT * FROM obs WHERE match_reason <> 'watchlist'
QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY id DESC) = 1""",
    "title_price": f"""SELECT profile_slug, source, title, min(price_cents) AS price_cents FROM (
  SELECT * FROM obs WHERE price_cents IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY id DESC) = 1)
WHERE price_cents > 0 GROUP BY 1, 2, 3""",
    "isbn_price": f"""SELECT profile_slug, source, isbn, min(price_cents) AS price_cents FROM (
  SELECT * FROM obs WHERE price_cents IS NOT NULL AND isbn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY id DESC) = 1)
WHERE price_cents > 0 GROUP BY 1, 2, 3""",
    "bundle_find": f"""SELECT id, profile_slug, isbn, title, price_cents FROM obs
WHERE match_reason IN ('watchlist', 'profile_author') AND price_cents > 0
  AND {looks_like_bundle('title')}""",
    "bundle_members": f"""SELECT f.id, f.profile_slug, f.price_cents, 'isbn' AS route, e.contained AS volume
FROM bundle_find f JOIN contains e ON e.isbn = f.isbn
UNION ALL
SELECT id, profile_slug, price_cents, 'title', unnest({volumes('title')}) FROM bundle_find""",
    "bundle_sizes": "SELECT id, route, count(*) AS volumes FROM bundle_members GROUP BY 1, 2",
    "advantages": """SELECT id, shop, volumes, singles, singles - price_cents AS saved_cents, saved_pct
FROM (
  SELECT m.id, m.price_cents, p.source AS shop, z.volumes, sum(p.price_cents) AS singles,
    CAST(round_even((sum(p.price_cents) - m.price_cents) * 100.0 / sum(p.price_cents), 0) AS INT) AS saved_pct,
    count(*) AS priced
  FROM bundle_members m
  JOIN bundle_sizes z ON z.id = m.id AND z.route = m.route
  JOIN (SELECT 'isbn' AS route, profile_slug, source, isbn AS volume, price_cents FROM isbn_price
        UNION ALL SELECT 'title', profile_slug, source, title, price_cents FROM title_price) p
    ON p.route = m.route AND p.volume = m.volume AND p.profile_slug = m.profile_slug
  WHERE p.source IN ('click', 'purchase') AND m.route = CASE WHEN EXISTS (
      SELECT 1 FROM bundle_sizes y WHERE y.id = m.id AND y.route = 'isbn' AND y.volumes >= 2)
    THEN 'isbn' ELSE 'title' END
  GROUP BY m.id, m.price_cents, p.source, z.volumes, m.route)
WHERE priced = volumes AND singles > price_cents AND saved_pct >= 25
QUALIFY row_number() OVER (PARTITION BY id ORDER BY shop) = 1""",
    "relation": """SELECT profile_slug, book_id, kind, arg_max(active, seq) AS active,
  arg_max(details, seq) FILTER (details IS NOT NULL) AS details FROM relation_log GROUP BY 1, 2, 3""",
    "link": """SELECT * FROM link_log
QUALIFY row_number() OVER (PARTITION BY book_id, source ORDER BY seq DESC) = 1""",
    "rating": """SELECT * FROM (SELECT * FROM rating_log
  QUALIFY row_number() OVER (PARTITION BY subject, origin ORDER BY seq DESC) = 1) WHERE NOT withdrawn""",
    "decided_item": """SELECT DISTINCT r.profile_slug, l.source, l.source_item_id
FROM link l JOIN relation r USING (book_id) WHERE r.active AND l.source_item_id IS NOT NULL""",
    "decided_isbn": """SELECT DISTINCT r.profile_slug, b.isbn, b.book_id
FROM book b JOIN relation r USING (book_id) WHERE r.active AND b.isbn IS NOT NULL""",
    "pile": f"""SELECT o.*, subject, r.stars, r.pitch, CASE WHEN {junk('o.price_cents', 'o.match_reason', 'o.title')} IS NOT NULL THEN 'hidden_junk'
  WHEN NOT {announce('a.id IS NOT NULL', 'o.')} THEN 'hidden_priced'
  WHEN r.stars < 3 THEN 'hidden_weak' ELSE 'shown' END AS status, a.saved_pct
FROM (SELECT *, {SUBJECT} AS subject FROM finds) o
LEFT JOIN advantages a ON a.id = o.id
LEFT JOIN (SELECT subject, stars, pitch FROM rating WHERE origin = 'model') r USING (subject)
WHERE NOT EXISTS (SELECT 1 FROM decided_item d WHERE d.profile_slug = o.profile_slug
    AND d.source = o.source AND d.source_item_id = o.source_item_id)
  AND NOT EXISTS (SELECT 1 FROM decided_isbn d WHERE d.profile_slug = o.profile_slug AND d.isbn = o.isbn)""",
    "entry": """SELECT r.profile_slug, r.book_id, b.title, b.author, r.active,
  json_extract_string(r.details, '$.restrict') AS restriction,
  coalesce(k.unsure, FALSE) AS needs_attention,
  r.active AND coalesce(k.choice, FALSE) AS needs_choice,
  r.active AND coalesce(k.missing, FALSE) AS missing,
  k.book_id IS NULL AS unresolved, f.availability, f.price_cents, f.seen_at,
  coalesce(f.price_cents > 0 AND f.price_cents < 500, FALSE) AS deal,
  coalesce(f.availability = 'available', FALSE) AS borrowable
FROM relation r JOIN book b USING (book_id)
LEFT JOIN (SELECT book_id, bool_or(outcome = 'unsure') AS unsure,
    bool_or(outcome = 'unsure' AND matched_title IS NOT NULL) AS choice,
    bool_and(outcome = 'not_found') AS missing FROM link GROUP BY 1) k ON k.book_id = r.book_id
LEFT JOIN (SELECT profile_slug, book_id,
    CASE min(CASE availability WHEN 'available' THEN 1 WHEN 'unavailable' THEN 2 WHEN 'unknown' THEN 3 END)
      WHEN 1 THEN 'available' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'unknown' END AS availability,
    arg_max(price_cents, id) FILTER (price_cents IS NOT NULL) AS price_cents,
    arg_max(observed_at, id) AS seen_at
  FROM (SELECT * FROM obs WHERE book_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY profile_slug, book_id, source ORDER BY id DESC) = 1)
  GROUP BY 1, 2) f ON f.profile_slug = r.profile_slug AND f.book_id = r.book_id
WHERE r.kind = 'watching' AND NOT EXISTS (SELECT 1 FROM relation x WHERE x.active
  AND x.kind IN ('owned', 'dismissed') AND x.book_id = r.book_id AND x.profile_slug = r.profile_slug)""",
    "delta": f"""SELECT * FROM (
  SELECT *, 'first_seen' AS kind FROM obs_prev o WHERE prev_id IS NULL AND {announce()}
  UNION ALL SELECT *, 'became_available' FROM obs_prev WHERE availability <> prev_av AND availability = 'available'
  UNION ALL SELECT *, 'price_drop' FROM obs_prev o WHERE price_cents < prev_price AND {announce()})""",
}


def _of_run(name: str, **sources: str) -> str:
    """A view over other rows: each name in it is replaced."""
    text = SQL_VIEWS[name]
    for old, new in sources.items():
        text = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", text)
    return text


LAST_RUN = "(SELECT max(run_id) FROM obs)"
_CLAIMS = """SELECT h.profile_slug, h.source, h.source_item_id, h.seq AS id, i.interest_id,
    CASE i.interest_key WHEN 'author' THEN 'profile_author' ELSE 'genre_category' END AS claimed_as,
    CASE i.interest_key WHEN 'author' THEN 2 ELSE 3 END AS channel
  FROM search_hit h JOIN interest_log l ON l.seq = h.search
  JOIN interest i ON i.profile_slug = h.profile_slug AND i.interest_key = l.interest_key AND i.value = l.value
  WHERE i.active
  UNION ALL SELECT profile_slug, source, source_item_id, id, NULL, 'watchlist', 1 FROM obs WHERE match_reason = 'watchlist'"""
SQL_VIEWS["interest"] = """SELECT profile_slug, interest_key, value, min(seq) AS interest_id,
  arg_max(active, seq) AS active FROM interest_log GROUP BY 1, 2, 3"""
SQL_VIEWS["origin"] = f"""SELECT {ITEM}, interest_id, claimed_as, found_by FROM (
  SELECT *, (SELECT count(DISTINCT interest_id) FROM claim d WHERE d.profile_slug = c.profile_slug
      AND d.source = c.source AND d.source_item_id = c.source_item_id) AS found_by FROM claim c)
QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY channel, id) = 1"""
SQL_VIEWS["claim"] = _CLAIMS
# The newest run against what was stored before it.
SQL_VIEWS["failed_source"] = """SELECT source, arg_max(error, seq) AS message FROM probe_log
LEFT JOIN (SELECT source, arg_max(enabled, seq) AS enabled FROM switch_log GROUP BY 1) w USING (source)
WHERE coalesce(enabled, TRUE) GROUP BY 1 HAVING NOT arg_max(ok, seq)"""
SQL_VIEWS["run_obs"] = f"""SELECT * FROM obs WHERE run_id = {LAST_RUN}
  AND source NOT IN (SELECT source FROM failed_source)
  AND source NOT IN (SELECT source FROM switch_log GROUP BY 1 HAVING NOT arg_max(enabled, seq))"""
SQL_VIEWS["stored_obs"] = f"SELECT * FROM obs WHERE run_id < {LAST_RUN}"
SQL_VIEWS["run_claim"] = _CLAIMS.replace("FROM obs", "FROM run_obs")
SQL_VIEWS["run_origin"] = _of_run("origin", claim="run_claim")
SQL_VIEWS["stored_title_price"] = _of_run("title_price", obs="stored_obs")
SQL_VIEWS["stored_isbn_price"] = _of_run("isbn_price", obs="stored_obs")
SQL_VIEWS["run_bundle"] = _of_run("bundle_find", obs="run_obs")
SQL_VIEWS["run_members"] = _of_run("bundle_members", bundle_find="run_bundle")
SQL_VIEWS["run_sizes"] = _of_run("bundle_sizes", bundle_members="run_members")
SQL_VIEWS["run_advantages"] = _of_run(
    "advantages", bundle_members="run_members", bundle_sizes="run_sizes",
    isbn_price="stored_isbn_price", title_price="stored_title_price",
)
SQL_VIEWS["run_prev"] = f"""SELECT o.*, b.id AS prev_id, b.price_cents AS prev_price,
  b.availability AS prev_av, b.reservation_count AS prev_res FROM run_obs o
LEFT JOIN (SELECT * FROM stored_obs QUALIFY row_number() OVER (PARTITION BY {ITEM} ORDER BY id DESC) = 1) b
  ON b.profile_slug = o.profile_slug AND b.source = o.source AND b.source_item_id = o.source_item_id"""
_TOLD = announce("EXISTS (SELECT 1 FROM run_advantages a WHERE a.id = o.id)")
SQL_VIEWS["run_delta"] = f"""SELECT d.* FROM (
  SELECT *, 'first_seen' AS kind FROM run_prev o WHERE prev_id IS NULL AND {_TOLD}
  UNION ALL SELECT *, 'became_available' FROM run_prev WHERE availability <> prev_av AND availability = 'available'
  UNION ALL SELECT *, 'price_drop' FROM run_prev o WHERE price_cents < prev_price AND {_TOLD}) d
LEFT JOIN run_origin g ON g.profile_slug = d.profile_slug AND g.source = d.source AND g.source_item_id = d.source_item_id
WHERE d.kind <> 'first_seen' OR d.match_reason = 'watchlist' OR g.interest_id IS NULL OR EXISTS (
  SELECT 1 FROM seed_log s WHERE s.interest_id = g.interest_id AND s.source = d.source)"""
