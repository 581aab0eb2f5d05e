"""Decisions on finds: rows that share the ids of new books, the same on every run."""

from pyspark.sql import functions as F

from folioflux.plans import decide

FINDS = (
    "id long, profile_slug string, source string, source_item_id string, kind string, isbn string, "
    "title string, author string, series string, url string"
)
BOOKS = "book_id long, isbn string, title string, author string, series string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_decided_finds_make_books_relations_and_links(spark):
    finds = spark.createDataFrame(
        [
            (10, "p", "shop", "1", "owned", None, "Der Schwarm", "Schätzing, Frank", None, "u1"),
            (11, "p", "shop", "2", "watching", None, "Kaltes Eis", "Jo Nesbo", "Hole", "u2"),
            (12, "q", "library", "3", "liked", None, "Kaltes Eis", "Nesbo, Jo", None, "u3"),
            (13, "p", "shop", "4", "dismissed", "9780000000007", "Roter Sand", "Anna Meier", None, "u4"),
            (14, "p", "shop", "5", "dismissed", "9780000000007", "Roter Sand (neu)", "Anna Meier", None, "u5"),
        ],
        FINDS,
    )
    books = spark.createDataFrame([(7, None, "Der Schwarm", "Frank Schätzing", None)], BOOKS)
    now = F.lit("2024-05-01").cast("timestamp_ntz")
    made = decide.decide(finds, books, now)
    assert rows(made.books.select("book_id", "isbn", "title")) == [
        (8, None, "Kaltes Eis"), (9, "9780000000007", "Roter Sand")
    ]
    assert rows(made.relations.select("profile_slug", "book_id", "kind")) == [
        ("p", 7, "owned"), ("p", 8, "watching"), ("p", 9, "dismissed"), ("q", 8, "liked")
    ]
    assert rows(made.links.select("book_id", "source", "source_item_id", "url", "outcome")) == [
        (7, "shop", "1", "u1", "confirmed"), (8, "library", "3", "u3", "confirmed"),
        (8, "shop", "2", "u2", "confirmed"), (9, "shop", "5", "u5", "confirmed"),
    ]
    again = decide.decide(finds.repartition(5), books, now)
    for name in ("books", "relations", "links"):
        assert rows(getattr(made, name)) == rows(getattr(again, name))


def test_ids_follow_the_greatest_known_one(spark):
    assigned = spark.range(300).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("book:"), F.col("id")))
        .otherwise(F.concat(F.lit("new:"), F.col("id") - F.col("id") % 2)).alias("book_key"),
    )
    books = spark.range(500).select(F.col("id").alias("book_id"))
    got = decide.with_ids(assigned, books)
    new = sorted({r["book_id"] for r in got.filter("is_new").collect()})
    assert new == list(range(500, 500 + len(new)))
    keys = got.join(assigned, "item_id").groupBy("book_id").agg(F.count_distinct("book_key").alias("n"))
    assert keys.filter("n > 1").isEmpty()
    nothing = spark.createDataFrame([], "book_id long")
    assert got.filter("is_new").count() and decide.with_ids(assigned, nothing).filter("is_new").agg(F.min("book_id")).first()[0] == 1
