"""Shards: the capacity is the smallest there is, groups stay together, slots have no gap."""

import random

import pytest
from pyspark.sql import functions as F

from folioflux.llm import sharding


def greedy(sizes, capacity):
    """Shards of neighbours; a size above the capacity stands alone."""
    shards, held = [], None
    for i, size in enumerate(sizes):
        if size > capacity:
            shards.append([i])
            held = None
        elif held is None or held + size > capacity:
            shards.append([i])
            held = size
        else:
            shards[-1].append(i)
            held += size
    return shards


def smallest(sizes, shards):
    """By trying every capacity from zero on."""
    capacity = 0
    while len(greedy(sizes, capacity)) > shards:
        capacity += 1
    return capacity


def least_largest(sizes, shards):
    """The smallest largest shard over all ways to cut, by a table over prefixes."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [
            min(max(best[j], sums[i] - sums[j]) for j in range(i)) for i in range(1, len(sums))
        ]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("blocks", [4, 16, 1 << 15])
def test_cuts_equal_brute_force(spark, seed, blocks):
    draw = random.Random(seed)
    heavy = seed % 2
    keys = sorted(draw.sample(range(1 << sharding.KEY_BITS), 60))
    sizes = [draw.randint(1, 30) * (40 if heavy and draw.random() < 0.05 else 1) for _ in keys]
    shards = draw.choice([1, 3, 7, 12])
    groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    cuts = sharding.minimax_cuts(groups, shards, blocks)
    assert cuts.capacity == smallest(sizes, shards)
    wanted = greedy(sizes, cuts.capacity)
    assert list(cuts.starts) == [keys[run[0]] for run in wanted[1:]]
    largest = max(sum(sizes[i] for i in run) for run in wanted)
    assert largest == least_largest(sizes, shards)


def test_a_group_with_most_bytes_does_not_widen_the_other_shards(spark):
    keys = [i << 50 for i in range(1, 101)]
    sizes = [10] * 100
    sizes[37] = 5000
    groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    cuts = sharding.minimax_cuts(groups, 12, 8)
    found = [sum(sizes[i] for i in run) for run in greedy(sizes, cuts.capacity)]
    assert sorted(found)[-1] == 5000 and sorted(found)[-2] == cuts.capacity == 100


def test_texts_stay_together_and_slots_are_gapless(spark):
    texts = ["alpha beta " * (i % 7) for i in range(50)] + [None, "", "copy", "copy"] * 10
    rows = [(i if i % 11 else None, t, "a", i % 3, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Shard` string, `slot` int, `_shard_key` string")
    placed, shard, slot = sharding.assign(docs, 5)
    assert placed.count() == len(texts) and {"Shard", "slot", "_shard_key"} <= set(placed.columns)
    together = placed.groupBy(F.coalesce("text", F.lit(""))).agg(F.count_distinct(shard).alias("n"))
    assert together.filter("n > 1").isEmpty()
    slots = placed.groupBy(shard).agg(F.sort_array(F.collect_list(slot)).alias("s")).collect()
    assert all(list(r["s"]) == list(range(len(r["s"]))) for r in slots)
    found = sharding.digest(docs, 5)
    assert found.filter("size = 16").count() == 20 + sum(1 for t in texts[:50] if not t)
    assert found.filter("text_crc32 = 0 and size <> 16").isEmpty()
    assert sorted(r["size"] for r in found.collect()) == sorted(len((t or "").encode()) + 16 for t in texts)


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("wort "), F.col("id").cast("int") % 20).alias("text"), F.lit(1).alias("shard")
    )
    folder = str(tmp_path / "shards")
    shard = sharding.write_shards(docs, folder, 4)
    back = spark.read.parquet(folder)
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(300))
    assert back.select(shard).distinct().count() <= 4


def test_no_python_and_no_rows_in_the_plan(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    plan = sharding.digest(docs, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digest(docs).collect() == []
    assert sharding.assign(docs)[0].collect() == []
