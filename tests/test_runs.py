"""Committed runs, the halt on throttling and the origin of finds."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from folioflux.sources import collect, records, sinks


def base():
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), "runs")


def rows(spark, run_id, *values):
    return spark.createDataFrame([(run_id, v) for v in values], "run_id int, value string")


def values(spark, folder, name, run_id=None):
    return sorted((r.run_id, r.value) for r in sinks.committed(spark, folder, name, run_id).collect())


def test_a_run_counts_once_its_manifest_is_written(spark):
    folder = base()
    first = sinks.RunWriter(spark, folder, 1)
    kept = first.keep("rows", rows(spark, 1, "a", "b"))
    assert kept.columns == ["run_id", "value"] and kept.count() == 2
    first.keep("digest", rows(spark, 1, "d"))
    assert values(spark, folder, "rows") == []
    first.commit()
    assert values(spark, folder, "rows") == [(1, "a"), (1, "b")]

    # Broken half-way: the rows are there, the digest and the manifest are not.
    sinks.RunWriter(spark, folder, 2).keep("rows", rows(spark, 2, "half"))
    assert values(spark, folder, "rows") == [(1, "a"), (1, "b")]
    again = sinks.RunWriter(spark, folder, 2)
    assert again.attempt == 1
    again.keep("rows", rows(spark, 2, "whole"))
    again.commit()
    assert values(spark, folder, "rows") == [(1, "a"), (1, "b"), (2, "whole")]
    assert values(spark, folder, "digest") == [(1, "d")]


def test_a_broken_repetition_leaves_the_committed_run(spark):
    folder = base()
    first = sinks.RunWriter(spark, folder, 7)
    first.keep("rows", rows(spark, 7, "old"))
    first.commit()
    second = sinks.RunWriter(spark, folder, 7)
    second.keep("rows", rows(spark, 7, "new"))
    assert values(spark, folder, "rows") == [(7, "old")]
    second.commit()
    assert values(spark, folder, "rows", 7) == [(7, "new")]


def test_one_run_reads_its_own_folders(spark):
    folder = base()
    for run_id in (1, 2, 3):
        writer = sinks.RunWriter(spark, folder, run_id)
        writer.keep("rows", rows(spark, run_id, "x"))
        writer.commit()
    frame = sinks.committed(spark, folder, "rows", 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert [r.run_id for r in frame.collect()] == [2]


LOG = "id long, profile_slug string, isbn string"
KNOWN = "seq long, isbn string, found boolean, title string, checked_at timestamp_ntz"
ANSWER = "isbn string, throttled boolean, found boolean, title string"


def enriched(spark, log, known, answers, edges=(), budget=10):
    return records.enrich(
        spark.createDataFrame(log, LOG), spark.createDataFrame(known, KNOWN),
        spark.createDataFrame(answers, ANSWER),
        spark.createDataFrame(list(edges), "isbn string, contained string"), budget,
        F.lit("2001-08-01 03:00:00").cast("timestamp_ntz"),
    )


def test_the_first_throttled_answer_halts_its_profile(spark):
    log = [(i, "p", f"i{i}") for i in range(1, 8)] + [(20, "q", "i1"), (21, "q", None), (22, "q", "")]
    answers = [("i7", False, True, "T7"), ("i6", False, False, None), ("i4", True, None, None),
               ("i3", False, True, "T3"), ("i2", True, None, None), ("i1", False, True, "T1")]
    got = enriched(spark, log, [], answers, [("i7", "v1"), ("i7", "v1"), ("i3", "v2")])
    asked = {(r.profile_slug, r.isbn): r.outcome for r in got.asked.collect()}
    # i5 never answers, which halts nothing; i3 and i2 come after the halt at i4.
    assert asked == {
        ("p", "i7"): "found", ("p", "i6"): "nothing", ("p", "i5"): "failed",
        ("p", "i4"): "throttled", ("q", "i1"): "found",
    }
    assert {r.isbn: r.found for r in got.records.collect()} == {"i7": True, "i6": False, "i1": True}
    assert [(r.isbn, r.contained) for r in got.edges.collect()] == [("i7", "v1")]
    report = {r.profile_slug: (r.asked, r.answered, r.halted) for r in got.report.collect()}
    assert report == {"p": (4, 1, True), "q": (1, 1, False)}


def test_what_was_asked_is_not_asked_again(spark):
    log = [(1, "p", "a"), (2, "p", "b"), (3, "p", "c")]
    known = [(5, "c", False, None, None)]
    answers = [(x, False, x == "a", x.upper() if x == "a" else None) for x in "abc"]
    got = enriched(spark, log, known, answers, budget=1)
    assert [r.isbn for r in got.asked.collect()] == ["b"]
    assert {r.isbn: r.found for r in got.cache.collect()} == {"c": False, "b": False}
    nothing = enriched(spark, [], [], [])
    assert nothing.asked.count() == nothing.records.count() == nothing.report.count() == 0


ITEM = ["profile_slug", "source", "source_item_id"]
HIT = "profile_slug string, source string, source_item_id string, interest_key string, value string, id long"
INTEREST = "profile_slug string, interest_key string, value string, active boolean, interest_id long"


@pytest.mark.parametrize("seed", [1, 2])
def test_origins_equal_claims_in_order(spark, seed):
    rng = random.Random(seed)
    interests = [
        (p, key, value, rng.random() < 0.7, number)
        for number, (p, key, value) in enumerate(
            (p, key, value) for p in "pq" for key in ("author", "thema") for value in "xyz")
    ]
    hits = [
        (rng.choice("pq"), rng.choice("st"), str(rng.randrange(6)), rng.choice(("author", "thema")),
         rng.choice("xyzw"), i) for i in range(80)
    ]
    finds = [
        (rng.choice("pq"), rng.choice("st"), str(rng.randrange(8)),
         rng.choice(("watchlist", "profile_author", "genre_category")), 100 + i) for i in range(12)
    ]
    known = {(p, k, v): n for p, k, v, active, n in interests if active}
    claims = [((p, s, i), 0, n, None) for p, s, i, why, n in finds if why == "watchlist"]
    claims += [
        ((p, s, i), 1 if k == "author" else 2, n, known[p, k, v])
        for p, s, i, k, v, n in hits if (p, k, v) in known
    ]
    want, found_by = {}, {}
    for item, channel, number, interest in sorted(claims, key=lambda x: x[1:3]):
        want.setdefault(item, interest)
        found_by.setdefault(item, set()).update(() if interest is None else (interest,))
    got = collect.origins(
        spark.createDataFrame(finds, "profile_slug string, source string, source_item_id string, match_reason string, id long"),
        spark.createDataFrame(hits, HIT), spark.createDataFrame(interests, INTEREST),
    ).collect()
    assert len(got) == len(want)
    for r in got:
        item = (r.profile_slug, r.source, r.source_item_id)
        assert (r.interest_id, r.found_by) == (want[item], len(found_by[item]))
