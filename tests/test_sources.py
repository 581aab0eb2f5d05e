"""Readers on small answers, and appended runs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.sources import catalogue_json, marc, pages, sinks, validation


def field(tag, *subs):
    inner = "".join(f'<subfield code="{c}">{v}</subfield>' for c, v in subs)
    return f'<datafield tag="{tag}" ind1=" " ind2=" ">{inner}</datafield>'


def answer(count, *fields):
    return (
        '<?xml version="1.0" encoding="UTF-8"?><searchRetrieveResponse xmlns="http://www.loc.gov/zing/srw/">'
        f"<version>1.1</version><numberOfRecords>{count}</numberOfRecords><records><record><recordData>"
        '<record xmlns="http://www.loc.gov/MARC21/slim" type="Bibliographic">'
        f"{''.join(fields)}</record></recordData></record></records></searchRetrieveResponse>"
    )


def test_marc_records(spark):
    full = answer(
        1, field("041", ("a", "ger")), field("100", ("a", "Beckett, Simon"), ("4", "aut")),
        field("245", ("a", "&#152;Die&#156; Chemie"), ("b", "Thriller"), ("c", "Simon Beckett")),
        field("490", ("a", "David Hunter"), ("v", "1")),
        field("770", ("i", "Enthält"), ("z", "9783644200418"), ("z", "9783644200616")),
        field("770", ("i", "Enthält"), ("z", "9783644200418"), ("z", "3644200")),
        field("770", ("i", "Siehe auch"), ("z", "9783644204119")),
    )
    nothing = "<searchRetrieveResponse><numberOfRecords>0</numberOfRecords><records/></searchRetrieveResponse>"
    frame = spark.createDataFrame([("a", full), ("b", nothing)], "isbn string, xml string")
    rows, edges = marc.records(frame)
    got = {r.isbn: r.asDict() for r in rows.collect()}
    assert got["a"] == {
        "isbn": "a", "title": "Die Chemie", "subtitle": "Thriller", "author": "Beckett, Simon",
        "series": "David Hunter", "series_index": "1", "language": "ger", "found": True,
    }
    assert got["b"]["found"] is False
    assert [r.contained for r in edges.orderBy("contained").collect()] == ["9783644200418", "9783644200616"]


def test_marc_answers_of_odd_form(spark):
    whole = answer(1, field("245", ("a", "Ein<!-- alt --> Titel"), ("c", "Wer")))
    # A second piece of record data adds its fields and hides none.
    two = whole.replace("</recordData>", f"</recordData><recordData><record>{field('490', ('a', 'Reihe'))}</record></recordData>")
    rows = [("a", whole), ("b", two), ("c", whole[:-40]), ("d", None), ("e", "kein xml"), ("f", whole + " Rest")]
    found, edges = marc.records(spark.createDataFrame(rows, "isbn string, xml string"))
    got = {r.isbn: (r.title, r.series, r.found) for r in found.collect()}
    assert got == {
        "a": ("Ein Titel", None, True), "b": ("Ein Titel", "Reihe", True), "c": (None, None, False),
        "d": (None, None, False), "e": (None, None, False), "f": ("Ein Titel", None, True),
    }
    assert edges.isEmpty()


def test_json_answers(spark):
    rows = [
        (1, '{"id":"7","title":" Dark Matter ","firstCreatorName":"Blake Crouch","ownedCopies":2,'
            '"availableCopies":0,"holdsCount":3,"formats":[{},{"isbn":"978-3-641-17293-0"}]}'),
        (2, '{"id":"8","title":"Ohne Zahl","ownedCopies":true,"availableCopies":0,"holdsCount":0}'),
        (3, "kein json"),
    ]
    good, bad = catalogue_json.title_records(spark.createDataFrame(rows, "n int, value string"))
    row = good.first()
    assert (row.title, row.isbn, row.availability, row.reservation_count) == (
        "Dark Matter", "9783641172930", "unavailable", 3,
    )
    assert {r.n: r.error for r in bad.collect()} == {2: "no ownedCopies", 3: "no title"}


def test_page_without_tiles(spark):
    frame = spark.createDataFrame(
        [(1, "<p>keine Artikel gefunden</p>"), (2, "<p>neu</p>"), (3, '<div class="product--box" data-ordernumber="SW1"></div>')],
        "page_id int, html string",
    )
    tiles, errors = pages.listing_tiles(frame)
    assert tiles.count() == 0
    assert sorted(r.page_id for r in errors.collect()) == [2, 3]


def test_violations_stop_a_job(spark):
    rows = spark.createDataFrame([("A", "x"), ("a", "X"), ("", None)], "title string, author string")
    found = validation.watchlist_violations(validation.watchlist_rows(rows))
    assert sorted(r.violation for r in found.collect()) == ["duplicate", "missing title"]
    with pytest.raises(ValueError):
        validation.require_none(found, "watchlist")


LOG = (
    "id long, profile_slug string, source string, source_item_id string, run_id int, match_reason string, "
    "title string, price_cents int, availability string, reservation_count int, book_id long, blurb string, "
    "observed_at timestamp_ntz"
)


def row(id_, run, price):
    return (id_, "p", "s", "1", run, "watchlist", "T", price, None, None, None, None, None)


def test_appending_a_run_twice_replaces_it(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "log")
    rows = spark.createDataFrame([row(1, 1, 900), row(2, 2, 800)], LOG)
    for frame in (rows, rows.filter("run_id = 2")):
        sinks.append_run(sinks.observation_rows(frame, F.current_timestamp().cast("timestamp_ntz")), path)
    assert spark.read.parquet(path).count() == 2
