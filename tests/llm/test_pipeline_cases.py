"""The stages of the pipeline one after another on odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    """What each filtering stage leaves, and the pieces of the last one."""
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        # Kept in the driver: the tables are small.
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        left.append(docs)
    return left, corpus_pipeline.STAGES[-1][1](spark, docs, SF)


def test_null_texts_repeated_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text"))).withColumns(
        {"root": F.lit(1), "content": F.lit("x"), "node": F.lit(2), "keys": F.lit("y"), "score": F.lit(0.5)}
    )
    left, pieces = through(spark, odd.union(odd))
    ids = [sorted(r["doc_id"] for r in stage.select("doc_id").collect()) for stage in left]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    # Of repeated rows one stays, and of all rows without a text one at most.
    assert len(ids[2]) == len(set(ids[2])) and left[2].filter("text is null or trim(text) = ''").count() <= 1
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(ids[3])
    assert len(ids[3]) > 10


def test_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    left, pieces = through(spark, empty)
    assert all(stage.isEmpty() for stage in left) and pieces.isEmpty()
