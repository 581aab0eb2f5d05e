"""Where intermediate results go."""

import pytest

from folioflux.operators.ordered import spread_nulls
from folioflux.session import shared_folder
from pyspark.sql import functions as F


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        return self.value

    def set(self, name, value):
        self.value = value


class Session:
    def __init__(self, master, folder):
        self.conf = Conf(folder)
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda self: Conf(None)})()


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077", None), "x")
    assert shared_folder(Session("spark://host:7077", "s3a://b/c"), "x").startswith("s3a://b/c/x-")


def test_one_process_gets_one_folder_of_its_own():
    session = Session("local[2]", None)
    first, second = shared_folder(session, "a"), shared_folder(session, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_spread_nulls_match_nothing(spark):
    left = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("key"))
    keys = left.withColumn("k", spread_nulls(F.col("key"), "id"))
    assert keys.select("k").distinct().count() == 100
    right = spark.createDataFrame([("0",), (None,)], "k string")
    assert [r["id"] for r in keys.join(right, "k").collect()] == [0]
