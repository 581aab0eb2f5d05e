"""A search with many hits of few spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.sources import collect


def test_each_pair_of_spellings_is_scored_once(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(wanted, credited):
        scored.add(1)
        return wanted.lower() == credited.lower()

    monkeypatch.setattr(collect, "author_matches", same)
    hits = spark.range(2000).select(
        F.lit("Anna Meier").alias("author"), F.lit("laden").alias("source"),
        F.col("id").cast("string").alias("source_item_id"), F.col("id").alias("rank"),
        F.when(F.col("id") % 4 == 0, "ANNA MEIER").otherwise(F.concat(F.lit("Bernd "), F.col("id") % 3)).alias("credited"),
    )
    hub = hits.limit(0)
    assert collect.by_author(hub, hits).count() == 500
    assert scored.value == 4
