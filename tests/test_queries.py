"""Registered queries against their SQL on the smallest tables.

A part of them by default; all of them with FOLIOFLUX_ALL=1.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "agg_01_change_feed", "agg_03", "agg_04", "agg_07", "agg_12", "agg_15", "er_01", "er_02", "er_03", "top_05", "fn_07", "st_06", "flt_04", "flt_06",
    "flt_12", "fn_01_fold", "fn_02", "fn_06", "fn_16", "fn_27", "fn_38", "join_02", "join_07",
    "join_09", "join_20", "q_02", "q_09_seed_rows", "q_10_run_digest", "q_10_committed_rows", "q_11_entry", "q_12", "q_13", "snk_02", "src_04", "src_06_listing_errors",
    "src_10", "src_14", "st_01", "st_11", "st_12", "str_01", "top_01", "win_01", "win_02", "win_09", "win_10",
)

#: The smallest tables have no row for these.
MAY_BE_EMPTY: set[str] = {"q_11_entry_rows"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def names():
    every = os.environ.get("FOLIOFLUX_ALL") == "1"
    return [n for n in entry.oracle_sql() if every or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    result = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result == "" or result == "EMPTY" and name in MAY_BE_EMPTY, result


def test_flagship_query_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
