"""What a worker is handed at once when blocks are compared."""

from pyspark.sql import functions as F

from folioflux.llm import near_copies


def test_a_batch_holds_few_pairs_of_blocks(spark, monkeypatch):
    most = spark.sparkContext.accumulator(0)
    forest = near_copies._forest

    def watched(batches):
        def seen():
            for batch in batches:
                if batch.num_rows > 8:
                    most.add(1)
                yield batch

        yield from forest(seen())

    monkeypatch.setattr(near_copies, "_forest", watched)
    # 80 keys in one task, each with two sets of different components that are equal but for one hash.
    pairs = spark.range(160, numPartitions=1).select(
        F.floor(F.col("id") / 2).alias("key"), F.lit(0).alias("segment"), F.col("id").alias("node"),
        F.col("id").alias("root"), F.lit(20).cast("long").alias("size"),
    )
    marks = pairs.select("node", F.array_repeat(F.lit(0), near_copies.SEGMENTS).alias("marks"))
    hashes = F.concat(F.sequence(100 * F.col("key"), 100 * F.col("key") + 18), F.array(-1 - F.col("node")))
    sets = pairs.select("node", hashes.alias("found"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    links = near_copies._within_blocks(pairs, marks, sets, 128)
    assert {(r.u // 2, r.v // 2) for r in links.collect()} == {(i, i) for i in range(80)}
    assert most.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
