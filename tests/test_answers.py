"""Stored answers as a data source: pieces, error rows and clean blurbs."""

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from folioflux.sources import answers

FACTS = {"source_item_id": "number", "title": "name", "blurb": "text"}


def stored(name, rows, group=2):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    columns = {key: [row[i] for row in rows] for i, key in enumerate(("number", "name", "text"))}
    pq.write_table(pa.table(columns), path, row_group_size=group)
    return path


def test_a_failing_source_leaves_an_error_row_and_the_others_go_on(spark):
    good = stored("a.parquet", [(i, f"T{i}", "Ein Text  Mehr navigate_next") for i in range(5)])
    bad = stored("b.parquet", [(1, "x", "y")])
    with open(bad, "r+b") as file:
        file.truncate(20)
    items, failures = answers.collect(spark, {
        "gut": (good, FACTS), "kaputt": (bad, FACTS), "weg": (good + ".gone", FACTS),
        "andere": (good, {"title": "no_such_column"}),
    })
    got = sorted((r.source, r.source_item_id, r.title, r.author, r.blurb) for r in items.collect())
    assert got == [("gut", str(i), f"T{i}", None, "Ein Text") for i in range(5)]
    failed = [r.source for r in failures.collect()]
    # A column that is not there fails in each of the three pieces.
    assert sorted(failed) == ["andere"] * 3 + ["kaputt", "weg"]
    assert all(r.message for r in failures.collect())


def test_pieces_are_row_groups_and_an_empty_source_is_no_failure(spark):
    options = {"source": "s", "path": stored("c.parquet", [(i, "n", None) for i in range(7)])}
    pieces = answers.AnswersReader(options).partitions()
    assert [(p.group, p.error) for p in pieces] == [(0, None), (1, None), (2, None), (3, None)]
    empty = stored("d.parquet", [])
    pq.write_table(pa.table({k: pa.array([], pa.string()) for k in ("number", "name", "text")}), empty)
    items, failures = answers.collect(spark, {"leer": (empty, FACTS)})
    assert items.count() == failures.count() == 0
