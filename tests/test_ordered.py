"""The ranged reductions equal plain windows, wherever the ranges are cut."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflux.operators import changes, ordered


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds a third of all rows.
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        (F.xxhash64("id") % 5).alias("value"),
        F.floor(F.col("id") / 250).cast("int").alias("run_id"),
    )


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_previous_value(rows, parts):
    mine = ordered.previous_value(rows, ["key"], "id", "value", "before", parts)
    plain = rows.withColumn("before", F.lag("value").over(Window.partitionBy("key").orderBy("id")))
    same(mine.select("id", "before"), plain.select("id", "before"))


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("down", [True, False])
def test_position(rows, parts, down):
    mine = ordered.position(
        rows, ["key"], "id", "place", coarse=[("value", True)], descending=down, parts=parts
    )
    order = F.col("id").desc() if down else F.col("id").asc()
    plain = rows.withColumn(
        "place",
        F.row_number().over(Window.partitionBy("key").orderBy(F.col("value").desc(), order)),
    )
    same(mine.select("id", "place"), plain.select("id", "place"))


def test_position_without_key(rows):
    mine = ordered.position(rows, [], "id", "place", parts=9)
    assert mine.filter("place <> id + 1").count() == 0


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_running_max(rows, parts):
    sparse = rows.withColumn("mark", F.when(F.col("id") % 7 == 0, F.col("id")))
    mine = ordered.running_max(sparse, ["key"], "id", "mark", "last", parts)
    window = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    plain = sparse.withColumn("last", F.max("mark").over(window))
    same(mine.select("id", "last"), plain.select("id", "last"))


def test_latest_first_and_top(rows):
    latest = ordered.latest(rows, ["key"]).select("key", "id")
    same(latest, rows.groupBy("key").agg(F.max("id").alias("id")))
    first = ordered.first(rows, ["key"], ["value", "id"]).select("key", "id")
    same(first, rows.groupBy("key").agg(F.min(F.struct("value", "id")).alias("m")).select("key", "m.id"))
    top = ordered.top_per_key(rows, ["key"], [F.col("id").desc()], 4)
    assert top.filter("key = 'hot'").count() == 4


def test_top_per_key_limits_before_the_shuffle(rows):
    plan = ordered.top_per_key(rows, ["key"], [F.col("id").desc()], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_state_before_run_sees_no_row_of_its_own_run(spark):
    log = spark.createDataFrame(
        [(1, 1, 500, "x"), (2, 1, 400, "x"), (3, 2, 300, "x"), (4, 2, 600, "x"), (5, 4, 100, "x")],
        "id long, run_id int, price_cents int, k string",
    )
    got = changes.with_previous(log, ["k"], ["id", "price_cents"]).select("id", "previous.id")
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, None), (3, 2), (4, 2), (5, 4)]


def test_sparse_ids_of_one_key_make_few_ranges(spark):
    # Hashed ids: every id lies far from the next one, and all rows have one key.
    rows = spark.range(5000).select(
        F.xxhash64("id").alias("id"), F.lit("p").alias("key"), (F.col("id") % 9).alias("value")
    )
    placed = ordered.position(rows, ["key"], "id", "place", parts=6)
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    same(placed.select("id", "place"), plain.select("id", "place"))
    before = ordered.previous_value(rows, ["key"], "id", "value", "before", 6)
    lagged = rows.withColumn("before", F.lag("value").over(Window.partitionBy("key").orderBy("id")))
    same(before.select("id", "before"), lagged.select("id", "before"))
    ranged = ordered.in_ranges(rows, ["key"], ["id"], 6)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * 5000 / 6


def test_no_window_over_the_bare_key(rows):
    placed = ordered.position(rows, ["key"], "id", "place", coarse=[("value", True)], parts=7)
    placed.collect()
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One is over (key, range); the other over the counts alone, one row a key and range.
    assert len(windows) == 2
    assert sum("row_number()" in w and "_part" in w.split("row_number()")[1] for w in windows) == 1
    assert sum("sum(_sum" in w for w in windows) == 1


def test_position_of_null_keys_and_ties(spark):
    rows = spark.createDataFrame(
        [(None, 1), (None, 1), (None, None), ("a", 2), ("a", None), ("a", 2)], "key string, o int"
    )
    got = ordered.position(rows, ["key"], ["o"], "place", parts=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(None, 1, 1), (None, 1, 2), (None, None, 3), ("a", 2, 1), ("a", 2, 2), ("a", None, 3)], key=str
    )
