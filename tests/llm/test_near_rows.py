"""How many rows and texts near_copies sends on."""

import pytest
from pyspark.sql import functions as F

from folioflux.llm import near_copies as near


def test_a_key_of_sets_that_stay_apart_sends_each_set_once(spark, monkeypatch):
    rows = {}
    written = near.written

    def counted(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near, "written", counted)
    rest = spark.range(300).select(
        F.lit(7).cast("long").alias("key"), F.lit(0).alias("segment"), F.col("id").alias("node"),
        F.col("id").alias("root"), F.lit(20).cast("long").alias("size"),
    )
    marks = rest.select("node", F.array_repeat(F.col("node").cast("int"), near.SEGMENTS).alias("marks"))
    hashes = F.concat(F.sequence(100 * F.col("node"), 100 * F.col("node") + 18), F.array(-1 - F.col("node")))
    # The last set is like the first.
    alike = F.when(F.col("node") == 299, F.concat(F.sequence(F.lit(0), F.lit(18)), F.array(F.lit(-300))).cast("array<long>"))
    sets = rest.select("node", F.coalesce(alike, hashes).alias("found"))
    links = near._within_blocks(rest, marks, sets, near.BLOCK).collect()
    assert [tuple(sorted(r)) for r in links] == [(0, 299)]
    assert rows["copies-blocks"] == 300
    # With too many shingles for one block the links are the same.
    monkeypatch.setattr(near, "WEIGHT", 1000)
    links = near._within_blocks(rest, marks, sets, near.BLOCK).collect()
    assert [tuple(sorted(r)) for r in links] == [(0, 299)] and rows["copies-large"] == 1


@pytest.mark.parametrize("bits", [1 << 24, 63, 7])
def test_the_map_of_wanted_texts_lets_all_of_them_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(near, "MAP_BITS", bits)
    texts = spark.range(2000).select(F.xxhash64("id").alias("content"), F.col("id").cast("string").alias("text"))
    wanted = texts.where("cast(text as int) % 20 = 0").select("content")
    passed = {r["text"] for r in near._maybe_wanted(texts, wanted).collect()}
    assert passed >= {str(i) for i in range(0, 2000, 20)}
    assert len(passed) < 110 or bits < 1000
    assert near._maybe_wanted(texts, wanted.limit(0)).count() == 0
