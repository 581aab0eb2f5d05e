"""Titles and people compared once each give the scores of all pairs of signatures."""

from pyspark.sql import functions as F

from folioflux.operators import linkage

TITLES = ["Der Schwarm", "Der Schwarm - Band 2", "Kaltes Eis", "Kaltes Eis / Roter Sand", ""]
PEOPLE = ["Frank Schätzing", "Schatzing, Frank", "Jo Nesbø", "Dr. Anna Meier, Bernd Schulz", None, ""]


def sides(spark):
    rows = [(i * 10 + j, t, a, "9780000000011" if (i + j) % 3 == 0 else None) for i, t in enumerate(TITLES) for j, a in enumerate(PEOPLE)]
    keyed = linkage._signatures(spark.createDataFrame(rows, "book_id long, title string, author string, isbn string"), "s")
    books = keyed.withColumns({"b_id": F.col("book_id"), "copies": F.lit(1).cast("long")})
    return keyed.withColumn("q_id", F.col("book_id")), books


def test_scores_by_form_are_the_scores_of_the_pairs(spark):
    queries, books = sides(spark)
    ids = queries.select("q_id").crossJoin(books.select("b_id"))
    names = ["q_id", "c_copies", *linkage.SCORED]
    every = linkage.score(linkage._pairs(ids, queries, books)).select(*names)
    by_form = linkage._scored_forms(ids, queries, books).select(*names)
    assert every.count() == by_form.count() > 0
    assert every.exceptAll(by_form).isEmpty() and by_form.exceptAll(every).isEmpty()
