"""Catalogue tables derived from the test tables, in Spark and as SQL views.

The test tables are a generic star schema; here they take the roles of an
observation log, change logs and dimensions. Every view is computed from whole
tables. ``VIEWS`` holds the same definitions for the SQL side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from folioflux.config import Profile

PROFILE = Profile(
    slug="p0",
    sources={
        "click": ("shop", "Klick-Laden"),
        "purchase": ("shop", "Kauf-Laden"),
        "view": ("library", "Leih-Bibliothek"),
        "signup": ("library", "Stadtbibliothek"),
    },
)

# Texts that give the log titles of every form the rules look at.
_TITLE = """CASE u % 10
    WHEN 0 THEN concat('Sammelband Nr. ', u)
    WHEN 1 THEN 'Der Schwarm'
    WHEN 2 THEN concat('Die Straße - Episode ', u)
    WHEN 3 THEN 'Kaltes Eis / Roter Sand'
    WHEN 4 THEN 'Kaltes Eis'
    WHEN 5 THEN 'Roter Sand'
    WHEN 6 THEN concat('Dark Matter. Zeitenläufer ', u % 7)
    WHEN 7 THEN 'Faust [Neue Auflage]'
    WHEN 8 THEN concat('3 Thriller: Nacht ', u % 5, ' / Tag ', u % 5)
    ELSE concat('Der Morgen - Band ', u % 4) END"""
_AUTHOR = """CASE u % 8
    WHEN 0 THEN NULL WHEN 1 THEN 'Schätzing, Frank' WHEN 2 THEN 'Frank Schätzing'
    WHEN 3 THEN 'Frank Schatzing' WHEN 4 THEN 'Jo Nesbø' WHEN 5 THEN 'Nesbø, Jo'
    WHEN 6 THEN 'Jo Nesbo' ELSE 'Anna Meier, Bernd Schulz' END"""
_CATEGORY = """CASE WHEN k % 3 <> 2 THEN NULL ELSE CASE u % 4
    WHEN 0 THEN 'belletristik/krimi-thriller/psychothriller'
    WHEN 1 THEN '/belletristik/science-fiction/space-opera/'
    WHEN 2 THEN 'sachbuch/wissen-NATUR-technik' ELSE NULL END END"""
_BLURB = """CASE k % 6
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('Ein Fall für ', u, ' …')
    WHEN 2 THEN concat('Ein  kurzer Anriss ', u, ' ... alles anzeigen expand_more Ein kurzer Anriss ', u, ' und der ganze Text.')
    WHEN 3 THEN concat('Lesen Sie navigate_next weiter ', k, ' Mehr navigate_next')
    WHEN 4 THEN concat('Ein ganzer Text über ', u, '. weniger anzeigen expand_less')
    ELSE concat('Ein anderer Text ', k, '...  ') END"""


def _obs_sql(dialect: str) -> str:
    spark = dialect == "spark"
    json_k = (
        "get_json_object(props, '$.k')" if spark else "json_extract_string(props, '$.k')"
    )
    days = (
        "datediff(cast(ts as date), date'2024-01-01')"
        if spark
        else "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    )
    text = "string" if spark else "varchar"
    return f"""
SELECT e AS id, cast({days} + 1 as int) AS run_id,
  concat('p', u % 3) AS profile_slug, source, cast(u as {text}) AS source_item_id,
  CASE k % 3 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'profile_author' ELSE 'genre_category' END AS match_reason,
  CASE WHEN k % 3 = 0 THEN u END AS book_id,
  CASE WHEN e % 97 = 0 THEN concat({_TITLE}, ' (neu)') ELSE {_TITLE} END AS title,
  {_AUTHOR} AS author,
  CASE WHEN k % 10 = 0 THEN NULL WHEN k % 11 = 0 THEN 0 ELSE cast(round(value * 100) as int) END AS price_cents,
  CASE WHEN k % 7 = 0 THEN cast(round(value * 100) as int) + k * 25 END AS original_price_cents,
  CASE k % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unknown' END AS availability,
  cast(k % 5 as int) AS reservation_count,
  {_CATEGORY} AS category,
  concat('https://shop.example/artikel/', u, '/titel?ref=', k, '#top') AS url,
  {_BLURB} AS blurb,
  CASE WHEN u % 6 = 0 THEN 'Roman' END AS subtitle,
  CASE WHEN u % 3 = 0 THEN NULL ELSE concat('978', lpad(cast(u as {text}), 10, '0')) END AS isbn,
  CASE WHEN u % 5 = 0 THEN 'Die Reihe' END AS series,
  CASE WHEN k % 9 = 0 THEN NULL ELSE concat('https://img.example/c/', u, '.JPEG') END AS cover_url,
  CASE WHEN k % 8 = 0 THEN NULL ELSE cast(k % 6 as int) END AS rating,
  cast(k % 3 as int) AS rating_votes,
  ts AS observed_at
FROM (SELECT event_id AS e, ts, user_id AS u, event_type AS source, value,
        cast({json_k} as int) AS k, props FROM events) t"""


def _shared(dialect: str) -> dict[str, str]:
    """Views whose text differs between the dialects only in type names."""
    text = "string" if dialect == "spark" else "varchar"
    source = """CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase'
    WHEN 3 THEN 'signup' ELSE 'error' END"""
    hour = "INTERVAL 1 HOUR" if dialect == "spark" else "INTERVAL '1' HOUR"
    return {
        "book": f"""
SELECT p_partkey AS book_id, concat(p_name, ' ', p_size % 7) AS title, p_brand AS author,
  CASE WHEN p_partkey % 5 = 0 THEN NULL
       ELSE concat('978', lpad(cast(p_partkey as {text}), 10, '0')) END AS isbn,
  CASE WHEN p_size % 4 = 0 THEN p_type END AS series,
  CASE WHEN p_size % 3 = 0 THEN concat('Text zu ', p_name) WHEN p_size % 3 = 1 THEN NULL
       ELSE '' END AS blurb,
  CASE WHEN p_partkey % 4 = 0 THEN concat(cast(p_partkey as {text}), '.jpg') END AS cover_file
FROM part""",
        "relation_log": f"""
SELECT o_orderkey AS seq, concat('p', o_orderkey % 3) AS profile_slug, o_custkey AS book_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'watching' WHEN '2' THEN 'owned'
    WHEN '3' THEN 'liked' WHEN '4' THEN 'disliked' ELSE 'dismissed' END AS kind,
  o_orderstatus <> 'F' AS active,
  CASE o_orderkey % 4 WHEN 0 THEN '{{"restrict":"library","note":"n"}}'
    WHEN 1 THEN '{{"restrict":"shop"}}' WHEN 2 THEN '{{}}' END AS details,
  o_orderdate AS created_at
FROM orders""",
        "link_log": f"""
SELECT o_orderkey AS seq, o_custkey AS book_id, {source} AS source,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_custkey as {text}) END AS source_item_id,
  CASE WHEN o_orderstatus = 'F' THEN NULL
       ELSE concat('https://shop.example/', o_orderkey, '/x') END AS url,
  CASE o_orderstatus WHEN 'O' THEN 'linked' WHEN 'F' THEN 'not_found' ELSE 'unsure' END AS outcome,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('red widget ', o_orderkey % 9) END AS matched_title,
  o_orderdate AS resolved_at
FROM orders""",
        "rating_log": f"""
SELECT c_custkey + 1000000 AS seq,
  CASE c_custkey % 3 WHEN 0 THEN concat('isbn:978', lpad(cast(c_custkey % 400 as {text}), 10, '0'))
    WHEN 1 THEN concat('item:', CASE c_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view'
      WHEN 2 THEN 'purchase' ELSE 'signup' END, ':', (c_custkey % 130) * 3)
    ELSE concat('book:', c_custkey % 300) END AS subject,
  CASE WHEN c_nationkey % 2 = 0 THEN 'model' WHEN c_nationkey % 5 = 1 THEN 'conversation'
    WHEN c_nationkey % 5 = 3 THEN 'reader' ELSE 'onleihe_readers' END AS origin,
  cast(c_custkey % 6 as double) AS stars,
  CASE WHEN c_nationkey % 3 = 0 THEN 'vermutet' WHEN c_nationkey % 3 = 1 THEN 'teils'
    ELSE 'belegt' END AS confidence,
  concat('Grund ', c_custkey) AS reason, concat('Pitch ', c_mktsegment) AS pitch,
  CASE WHEN c_custkey % 7 = 6 THEN 2 ELSE 1 END AS profile_version, FALSE AS withdrawn
FROM customer
UNION ALL
SELECT doc_id AS seq, concat('book:', doc_id) AS subject,
  CASE doc_id % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'conversation' WHEN 2 THEN 'reader'
    ELSE 'onleihe_readers' END AS origin,
  cast(3 * quality + 1 - toxic as double) AS stars,
  CASE WHEN doc_id % 3 = 0 THEN 'vermutet' ELSE 'belegt' END AS confidence,
  'Grund' AS reason, '' AS pitch, cast(1 + doc_id % 2 as int) AS profile_version,
  doc_id % 11 = 0 AS withdrawn
FROM labels""",
        "run_log": f"""
SELECT o_orderkey AS run_id, concat('p', o_custkey % 3) AS profile_slug,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'cli' WHEN '2' THEN 'cron' WHEN '3' THEN 'ui'
    ELSE 'entry' END AS run_trigger,
  o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + {hour} END AS finished_at,
  CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'error' ELSE 'running' END AS status,
  cast(o_custkey % 17 as int) AS delta_count,
  CASE WHEN o_orderstatus = 'F' THEN concat('click: Zeit ', o_custkey % 5, '; view: leer') END AS error
FROM orders""",
        "interest_log": """
SELECT c_custkey AS seq, concat('p', c_custkey % 3) AS profile_slug,
  CASE WHEN c_custkey % 2 = 0 THEN 'thema' ELSE 'author' END AS interest_key,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE concat('Brand#', c_nationkey) END AS value,
  c_custkey % 7 <> 0 AS active,
  CASE WHEN c_custkey % 4 = 1 THEN 'extended' ELSE 'core' END AS tier
FROM customer""",
        "contains": f"""
SELECT DISTINCT concat('978', lpad(cast(l_orderkey as {text}), 10, '0')) AS isbn,
  concat('978', lpad(cast(l_partkey % 100 as {text}), 10, '0')) AS contained
FROM lineitem""",
        "bundle": f"""
SELECT o_orderkey AS bundle_id, cast(round(o_totalprice) as int) AS price_cents FROM orders""",
        "bundle_volume": """
SELECT DISTINCT l_orderkey AS bundle_id, l_partkey AS contained FROM lineitem""",
        "single_price": """
SELECT p_partkey AS contained, cast(round(p_retailprice * 100) as int) AS price_cents FROM part""",
        "watchlist": """
SELECT p_partkey AS entry_id, concat(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END, p_name, ' ', p_size % 7) AS title,
  CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_brand END AS author,
  p_size % 3 <> 0 AS check_library, p_size % 4 <> 0 AS check_shop, p_size % 6 <> 0 AS active,
  p_partkey AS book_id
FROM part""",
        "probe_log": """
SELECT id AS seq, source, availability IS DISTINCT FROM 'unknown' AS ok,
  CASE WHEN availability = 'unknown' THEN concat('Fehler ', reservation_count) END AS error, observed_at AS probed_at
FROM obs""",
        # Answers of a library to an ISBN: some are throttled, some never come.
        "record_answer": f"""
SELECT concat('978', lpad(cast(c_custkey as {text}), 10, '0')) AS isbn, c_custkey % 29 = 3 AS throttled,
  CASE WHEN c_custkey % 29 <> 3 THEN c_custkey % 3 <> 0 END AS found,
  CASE WHEN c_custkey % 29 <> 3 AND c_custkey % 3 <> 0 THEN concat('Titel ', c_name) END AS title,
  CASE WHEN c_custkey % 29 <> 3 AND c_custkey % 3 <> 0 THEN c_mktsegment END AS series
FROM customer WHERE c_custkey % 11 <> 5""",
        "record_log": f"""
SELECT o_orderkey AS seq, concat('978', lpad(cast(o_custkey as {text}), 10, '0')) AS isbn,
  o_orderkey % 3 <> 0 AS found, CASE WHEN o_orderkey % 3 <> 0 THEN concat('Alt ', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 6 = 1 THEN 'Die Reihe' END AS series, o_orderdate AS checked_at
FROM orders WHERE o_custkey % 8 = 1""",
        # Which searches a sweep made, and what each brought.
        "search_hit": f"""
SELECT o_orderkey AS seq, o_custkey AS search, concat('p', o_custkey % 3) AS profile_slug, {source} AS source,
  cast((o_orderkey % 130) * 3 + o_custkey % 3 as {text}) AS source_item_id
FROM orders""",
        "seed_log": f"""
SELECT o_custkey AS interest_id, {source} AS source, o_orderdate AS seeded_at FROM orders WHERE o_orderstatus = 'P'""",
        "switch_log": """
SELECT s_suppkey AS seq, CASE s_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view'
  WHEN 2 THEN 'signup' ELSE 'unbekannt' END AS source, s_acctbal > 0 AS enabled
FROM supplier""",
    }


VIEWS: dict[str, str] = {"obs": _obs_sql("duckdb"), **_shared("duckdb")}
_SPARK_VIEWS: dict[str, str] = {"obs": _obs_sql("spark"), **_shared("spark")}


class Tables:
    """The raw tables of one directory and the catalogue views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A catalogue view; its SQL names raw tables or other views."""
        text = _SPARK_VIEWS[name].replace("{", "{{").replace("}", "}}")
        frames = {
            s: self.view(s) if s in _SPARK_VIEWS else self.raw(s)
            for s in re.findall(r"FROM\s+(\w+)", text)
            if s != "t"
        }
        for s in frames:
            text = re.sub(rf"\bFROM\s+{s}\b", f"FROM {{{s}}}", text)
        return self.spark.sql(text, **frames)

    @cached_property
    def obs(self) -> DataFrame:
        return self.view("obs")

    @cached_property
    def book(self) -> DataFrame:
        return self.view("book")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _SPARK_VIEWS:
            return self.view(name)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.raw(name)
