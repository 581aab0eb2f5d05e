"""Queries keep their helpers: no function of a workload module replaces another one."""

import ast
import collections
import glob
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
MODULES = sorted(glob.glob(os.path.join(os.path.dirname(entry.__file__), "folioflux", "workload", "*.py")))


@pytest.mark.parametrize("path", MODULES, ids=os.path.basename)
def test_no_function_is_defined_twice(path):
    with open(path, encoding="utf-8") as file:
        tree = ast.parse(file.read())
    names = collections.Counter(n.name for n in tree.body if isinstance(n, ast.FunctionDef) and n.name != "_")
    assert [n for n, times in names.items() if times > 1] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["q_07_gate_decisions", "agg_08_gate_counters"])
def test_gate_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""
