"""How often the state before a run and the prices are worked out."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import bundles
from folioflux.plans import jobs

OBS = (
    "profile_slug string, source string, source_item_id string, id long, run_id int, match_reason string, "
    "book_id long, title string, author string, isbn string, price_cents int, availability string"
)
ROWS = [
    ("p0", "laden", "1", 1, 1, "genre_category", None, "Nacht", "A", "9781", 900, "available"),
    ("p0", "laden", "1", 4, 2, "genre_category", None, "Nacht", "A", "9781", None, "available"),
    ("p0", "laden", "2", 2, 1, "genre_category", None, "Tag", "A", "9782", 800, "available"),
    ("p0", "laden", "2", 5, 2, "genre_category", None, "Tag", "A", None, 700, "available"),
    ("p0", "laden", "3", 3, 1, "genre_category", None, "Nacht / Tag", "A", "9783", 600, "available"),
    ("p0", "laden", "4", 6, 1, "genre_category", None, "", "A", "9784", 0, "available"),
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_one_pass_gives_both_price_lists(spark):
    log = spark.createDataFrame(ROWS, OBS)
    by_title, by_isbn, more = bundles.price_lists(log, F.max("id").alias("newest"))
    assert rows(by_title) == rows(bundles.last_prices(log, "title"))
    assert rows(by_title) == [("p0", "laden", "Nacht / Tag", 600), ("p0", "laden", "Nacht", 900), ("p0", "laden", "Tag", 700)]
    assert rows(by_isbn) == rows(bundles.last_prices(log, "isbn")) == [("p0", "laden", "9781", 900), ("p0", "laden", "9782", 800), ("p0", "laden", "9783", 600)]
    assert {(r["source_item_id"], r["newest"]) for r in more.collect()} == {("1", 4), ("2", 5), ("3", 3), ("4", 6)}


def test_both_kinds_of_sources_come_from_one_reading_of_the_probes(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(ok):
        read.add(1)
        return ok

    probes = spark.createDataFrame(
        [(1, "laden", True, None), (2, "laden", False, "Zeit"), (3, "haus", False, "leer"), (4, "haus", True, None)],
        "seq long, source string, ok boolean, error string",
    ).withColumns({"ok": seen("ok"), "probed_at": F.lit(None).cast("timestamp")})
    sources, failed = jobs.collecting_sources(
        spark.createDataFrame(ROWS, OBS).select("source").union(
            spark.createDataFrame([("haus",), ("neu",)], "source string")
        ),
        spark.createDataFrame([("neu", 1, True)], "source string, seq long, enabled boolean"), probes,
    )
    assert sorted(r[0] for r in sources.collect()) == ["haus", "neu"]
    assert [tuple(r) for r in failed.collect()] == [("laden", "Zeit")]
    assert read.value == 4
