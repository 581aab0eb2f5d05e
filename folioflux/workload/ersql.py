"""SQL-side record linkage: forms, measures and scores written for DuckDB's engine."""

from __future__ import annotations

from folioflux.functions.text import NAME_PARTICLES, NAME_PREFIXES, NAME_SUFFIXES, NON_NAMES, ORGANISATION_WORDS
from folioflux.workload.sqltext import fold, looks_like_bundle, titles


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence: one row of bits, a step a character."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = x THEN 1::HUGEINT << i ELSE 0::HUGEINT END))"
    steps = f"list_transform(string_split({b}, ''), lambda x: {mask})"
    return (
        f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce("
        f"list_prepend({full}, {steps}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})) END"
    )


_DROPPED = _list(NAME_PREFIXES + NAME_SUFFIXES + NAME_PARTICLES + NON_NAMES)
_ORGANISATIONS = _list(ORGANISATION_WORDS)
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"

ER_VIEWS = {
    "er_query": """SELECT entry_id AS query_id, title, nullif(trim(author), '') AS author,
  CASE WHEN entry_id % 9 = 0 THEN CAST(entry_id AS varchar) END AS identifier FROM watchlist""",
    "er_cand": """SELECT l.book_id AS query_id, l.seq AS rank,
  CASE l.seq % 6 WHEN 0 THEN b.title WHEN 1 THEN b.title || ' - Band ' || l.seq % 3 WHEN 2 THEN 'Der ' || b.title || ': Roman'
    WHEN 3 THEN b.title || ' und mehr' WHEN 4 THEN replace(b.title, 'e', 'ee') ELSE b.title || ' / Roter Sand' END AS title,
  CASE l.seq % 4 WHEN 0 THEN b.author WHEN 1 THEN 'Dr. ' || b.author WHEN 2 THEN 'Kim Mannix' END AS author,
  CASE WHEN l.seq % 9 = 0 THEN CAST(l.book_id AS varchar) END AS identifier
FROM link_log l JOIN book b ON b.book_id = l.book_id""",
    "er_norm": titles("SELECT title FROM er_query UNION ALL SELECT title FROM er_cand"),
    "er_title": f"""SELECT title, coalesce(norm, '') AS norm, {looks_like_bundle('title')} AS bundle,
  list_filter(string_split(coalesce(norm, ''), ' '), lambda w: w <> '' AND w NOT IN ('a','and','the','und','of','de')) AS tokens,
  CASE WHEN named <> '' THEN CAST(named AS INT) WHEN bare_no <> '' AND CAST(bare_no AS INT) <= 20 THEN CAST(bare_no AS INT) END AS volume
FROM (SELECT title, norm,
  regexp_extract(folded, '\\b(?:band|bd|teil|tl|folge|vol|volume|book)\\s*\\.?\\s*(\\d{{1,3}})\\b', 1) AS named,
  regexp_extract(trim(string_split_regex(folded, '\\s[-–—]\\s|:\\s|\\s/\\s')[1]), '^.*\\S.*?\\s(\\d{{1,3}})$', 1) AS bare_no
FROM er_norm)""",
    # People of a credit: a comma separates them where most parts are full names.
    "er_person": f"""SELECT author, full_name, coalesce(nullif(array_to_string(list_filter(
    string_split(full_name, ' '), lambda w: length(w) > 2), ' '), ''), full_name) AS short_name
FROM (
  SELECT author, CASE WHEN list_has_any(plain, {_ORGANISATIONS}) THEN array_to_string(plain, ' ')
    ELSE array_to_string(list_filter(ordered, lambda w: NOT list_contains({_DROPPED}, w)), ' ') END AS full_name
  FROM (
    SELECT author, {_WORDS.format("regexp_replace(person, '[-+.:;,!@#$%^&*()/\\s]+', ' ', 'g')")} AS plain,
      {_WORDS.format("regexp_replace(CASE WHEN contains(person, ',') THEN split_part(person, ',', 2) || ' ' || split_part(person, ',', 1) ELSE person END, '[-+.:;,!@#$%^&*()/\\s]+', ' ', 'g')")} AS ordered
    FROM (
      SELECT author, {fold('part')} AS person FROM (
        SELECT author, unnest(CASE WHEN 2 * len(list_filter(parts, lambda p: p LIKE '% %')) >= len(parts) AND len(parts) > 1
          THEN parts ELSE [author] END) AS part
        FROM (SELECT author, list_transform(string_split(author, ','), lambda p: trim(p)) AS parts
          FROM (SELECT author FROM er_query UNION SELECT author FROM er_cand) WHERE length(author) > 0)))))
WHERE full_name <> ''""",
    "er_people": """SELECT author, list(full_name) AS names, list(short_name) AS short_names,
  list_distinct(flatten(list(string_split(short_name, ' ')))) AS name_tokens FROM er_person GROUP BY 1""",
    "er_pair": """SELECT q.query_id, c.rank AS c_rank, q.author AS q_author, c.author AS c_author,
  q.identifier AS q_id, c.identifier AS c_id, a.norm AS q_norm, b.norm AS c_norm, a.volume AS q_volume, b.volume AS c_volume,
  a.bundle AS q_bundle, b.bundle AS c_bundle, a.tokens AS q_tokens, b.tokens AS c_tokens,
  coalesce(p.names, []) AS q_names, coalesce(r.names, []) AS c_names,
  coalesce(p.name_tokens, []) AS q_name_tokens, coalesce(r.name_tokens, []) AS c_name_tokens
FROM er_query q JOIN er_cand c ON c.query_id = q.query_id JOIN er_title a ON a.title = q.title JOIN er_title b ON b.title = c.title
LEFT JOIN er_people p ON p.author = q.author LEFT JOIN er_people r ON r.author = c.author""",
    "er_credit": "SELECT DISTINCT q_author, c_author FROM er_pair WHERE q_author IS NOT NULL AND c_author IS NOT NULL",
    "er_names": """SELECT e.q_author, e.c_author, a.full_name AS a, b.full_name AS b, a.short_name AS sa, b.short_name AS sb
FROM er_credit e JOIN er_person a ON a.author = e.q_author JOIN er_person b ON b.author = e.c_author""",
    "er_words": f"""SELECT a, b, array_to_string(list_sort({_WORDS.format('a')}), ' ') AS sort_a,
  array_to_string(list_sort({_WORDS.format('b')}), ' ') AS sort_b,
  list_distinct({_WORDS.format('a')}) AS set_a, list_distinct({_WORDS.format('b')}) AS set_b
FROM (SELECT q_norm AS a, c_norm AS b FROM er_pair UNION SELECT a, b FROM er_names UNION SELECT sa, sb FROM er_names) x""",
    "er_rest": """SELECT *, len(list_intersect(set_a, set_b)) AS shared,
  coalesce(length(array_to_string(list_intersect(set_a, set_b), ' ')), 0) AS base,
  coalesce(array_to_string(list_sort(list_filter(set_a, lambda w: NOT list_contains(set_b, w))), ' '), '') AS rest_a,
  coalesce(array_to_string(list_sort(list_filter(set_b, lambda w: NOT list_contains(set_a, w))), ' '), '') AS rest_b FROM er_words""",
    "er_measure": f"""SELECT a, b,
  CASE WHEN length(sort_a) + length(sort_b) = 0 THEN 100.0 ELSE 200.0 * ({common('sort_a', 'sort_b')}) / (length(sort_a) + length(sort_b)) END AS by_sort,
  CASE WHEN len(set_a) = 0 OR len(set_b) = 0 THEN 0.0 WHEN shared > 0 AND (rest_a = '' OR rest_b = '') THEN 100.0
    ELSE greatest(100.0 - 100.0 * (length(rest_a) + length(rest_b) - 2 * ({common('rest_a', 'rest_b')}))
        / (2 * (base + gap) + length(rest_a) + length(rest_b)),
      CASE WHEN base > 0 THEN 200.0 * base / (2 * base + gap + length(rest_a)) ELSE 0.0 END,
      CASE WHEN base > 0 THEN 200.0 * base / (2 * base + gap + length(rest_b)) ELSE 0.0 END) END AS by_set
FROM (SELECT *, CASE WHEN base > 0 THEN 1 ELSE 0 END AS gap FROM er_rest)""",
    "er_author": """SELECT n.q_author, n.c_author, CAST(round_even(max(greatest(f.by_set, s.by_set)), 0) AS INT) AS fuzzy,
  max(CASE WHEN n.a = n.b THEN 100.0 ELSE least(f.by_set, f.by_sort) END) AS strict
FROM er_names n JOIN er_measure f ON f.a = n.a AND f.b = n.b JOIN er_measure s ON s.a = n.sa AND s.b = n.sb GROUP BY 1, 2""",
    "er_scored": """SELECT p.query_id, p.c_rank, p.q_author,
  coalesce(q_id = c_id, FALSE) AS id_match, coalesce(q_id <> c_id, FALSE) AS id_conflict,
  q_norm <> '' AND q_norm = c_norm AS title_exact,
  CAST(round_even(least(m.by_set, m.by_sort), 0) AS INT) AS title_fuzzy,
  len(q_tokens) > 0 AND len(c_tokens) > len(q_tokens) AND list_has_all(c_tokens, q_tokens) AS title_contained,
  CASE WHEN q_volume IS NOT NULL AND c_volume IS NOT NULL THEN q_volume <> c_volume
    WHEN q_volume IS NULL AND c_volume IS NOT NULL THEN c_volume > 1 ELSE FALSE END AS volume_conflict,
  c_bundle AND NOT q_bundle AS is_bundle, list_has_any(q_names, c_names) AS author_exact,
  coalesce(a.fuzzy, 0) AS author_fuzzy, coalesce(a.strict, 0) AS author_strict,
  p.q_author IS NOT NULL AND p.c_author IS NOT NULL AND len(q_names) > 0 AND len(c_names) > 0
    AND coalesce(a.strict, 0) < 90 AND NOT list_has_any(q_name_tokens, c_name_tokens) AS author_conflict,
  p.q_author IS NOT NULL AND p.c_author IS NULL AS author_missing, 9999 AS year_delta
FROM er_pair p JOIN er_measure m ON m.a = q_norm AND m.b = c_norm
LEFT JOIN er_author a ON a.q_author = p.q_author AND a.c_author = p.c_author""",
    "er_ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT id_match, id_conflict, author_conflict,
  NOT title_exact, volume_conflict, is_bundle, NOT title_contained, author_missing, -(title_fuzzy // 5), NOT author_exact,
  -(author_fuzzy // 5), year_delta, c_rank) AS place FROM er_scored""",
    "er_tied": """SELECT o.*, abs(w.title_fuzzy - o.title_fuzzy) <= 3 AND w.author_fuzzy // 5 = o.author_fuzzy // 5
  AND w.title_exact = o.title_exact AND w.is_bundle = o.is_bundle AND w.volume_conflict = o.volume_conflict
  AND w.author_conflict = o.author_conflict AS tied
FROM er_ranked o JOIN er_ranked w ON w.query_id = o.query_id AND w.place = 1""",
    "er_two": """SELECT w.*, o.c_rank AS runner_up, coalesce(o.tied, FALSE) AS is_tied
FROM er_ranked w LEFT JOIN er_tied o ON o.query_id = w.query_id AND o.place = 2 WHERE w.place = 1""",
}

CONFIDENCE = """SELECT query_id, split_part(answer, '|', 1) AS confidence, split_part(answer, '|', 2) AS reason, winner FROM (
SELECT q.query_id, b.c_rank AS winner, CASE
  WHEN b.c_rank IS NULL THEN 'no_match|keine Kandidaten'
  WHEN id_match THEN 'auto_accept|Kennung stimmt überein'
  WHEN title_fuzzy < 85 AND title_contained AND NOT author_conflict AND NOT author_missing
    THEN 'provisional|der gesuchte Titel steckt im gefundenen — bitte bestätigen'
  WHEN title_fuzzy < 85 AND title_contained AND author_conflict
    THEN 'no_match|der Titel steckt im gefundenen, aber dort steht eine andere Autor:in'
  WHEN title_fuzzy < 85 AND title_contained THEN 'no_match|der Titel steckt im gefundenen, aber dort steht keine Autor:in'
  WHEN title_fuzzy < 85 THEN 'no_match|bester Titelwert ' || title_fuzzy || ' liegt unter 85'
  WHEN volume_conflict THEN 'provisional|der Treffer nennt einen anderen Band der Reihe'
  WHEN id_conflict THEN 'provisional|die Kennungen widersprechen sich'
  WHEN length(q.author) > 0 AND sure AND is_tied THEN 'provisional|zwei Kandidaten sind gleich gut'
  WHEN length(q.author) > 0 AND sure THEN 'auto_accept|Titel und Autor stimmen beide'
  WHEN length(q.author) > 0 THEN 'provisional|Titel ' || title_fuzzy || ', Autor ' || author_fuzzy || ' — nicht eindeutig'
  WHEN title_exact AND NOT is_tied THEN 'auto_accept|exakter Titel, kein konkurrierender Treffer, kein Autor angegeben'
  ELSE 'provisional|kein Autor am Eintrag, mit dem sich der Titel bestätigen ließe' END AS answer
FROM er_query q LEFT JOIN (SELECT *, (title_exact AND author_fuzzy >= 90) OR (title_fuzzy >= 95 AND author_exact) AS sure
  FROM er_two) b ON b.query_id = q.query_id)"""
