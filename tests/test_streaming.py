"""The change feed over micro-batches: late rows, repeats, and what a micro-batch costs."""

import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.operators import changes
from folioflux.streaming.feed import ChangeFeed, observations
from folioflux.streaming.history import previous_states, run_history

LOG = (
    "id long, profile_slug string, source string, source_item_id string, run_id int, match_reason string, "
    "title string, price_cents int, availability string, reservation_count int, book_id long, blurb string, "
    "observed_at timestamp_ntz"
)
STOCK = ["available", "unavailable", "unknown", None]


def row(id_, run, price, item="1", stock=None):
    return (id_, "p", "s", item, run, "watchlist", "T", price, stock, None, None, None, None)


def play(spark, base, batches, repeat=()):
    """Let micro-batches arrive one by one; those in ``repeat`` count as not finished at first."""
    feed = ChangeFeed(base, Profile(), os.path.join(base, "log"))
    checkpoint = os.path.join(base, "checkpoint")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(2).write.parquet(os.path.join(base, "in", str(number)))
        for attempt in range(2 if number in repeat else 1):
            if attempt:
                # The output is there but the micro-batch was never committed.
                os.remove(os.path.join(checkpoint, "commits", str(number)))
                crc = os.path.join(checkpoint, "commits", f".{number}.crc")
                if os.path.exists(crc):
                    os.remove(crc)
            stream = observations(spark, os.path.join(base, "in"), spark.createDataFrame([], LOG).schema)
            feed.start(stream, checkpoint).awaitTermination()
    return feed


def told(frame):
    return sorted((r.id, r.position, r.kind) for r in frame.collect())


def at_once(spark, batches):
    log = spark.createDataFrame([r for rows in batches for r in rows], LOG)
    return told(changes.changes(changes.with_previous(log), Profile()))


def test_late_row_mends_its_run_and_the_next(spark):
    batches = [
        [row(1, 1, 900), row(2, 2, 800)],
        [row(3, 2, 700), row(4, 4, 750)],
        [row(5, 3, 990), row(6, 5, 600)],  # run 3 comes after run 4
        [row(7, 1, 100)],  # and more of run 1, newer than what was known of it
    ]
    feed = play(spark, tempfile.mkdtemp(prefix="spark-"), batches)
    got = told(feed.read(spark))
    assert got == at_once(spark, batches)
    # Row 4 was a rise over 700 and is a drop from 990; rows 2 and 3 now rise over 100.
    assert {(i, k) for i, _, k in got} >= {(4, "price_drop"), (2, "price_rise"), (3, "price_rise"), (5, "price_rise")}
    assert (4, 1, "price_rise") not in got
    assert sorted(r.id for r in spark.read.parquet(feed.log).collect()) == list(range(1, 8))


def test_repeated_micro_batches_change_nothing(spark):
    draw = random.Random(4)
    rows = [
        row(i, draw.randint(1, 6), draw.choice([None, 0, 500, 700, 900]), draw.choice("aaab"), draw.choice(STOCK))
        for i in range(60)
    ]
    # Any row may come in any micro-batch, so most runs have late rows.
    draw.shuffle(rows)
    batches = [rows[:25], rows[25:26], rows[26:60]]
    feed = play(spark, tempfile.mkdtemp(prefix="spark-"), batches, repeat={1, 2})
    assert told(feed.read(spark)) == at_once(spark, batches)
    assert sorted(r.id for r in spark.read.parquet(feed.log).collect()) == list(range(60))


def test_a_micro_batch_touches_its_own_items_only(spark):
    many = [row(i, 1, 900, f"item {i}") for i in range(400)]
    base = tempfile.mkdtemp(prefix="spark-")
    feed = play(spark, base, [many, [row(1000, 2, 800, "item 7")]])
    told_of = spark.read.parquet(os.path.join(base, "steps")).filter("part = 'run'").groupBy("batch").count()
    assert {r["batch"]: r["count"] for r in told_of.collect()} == {0: 400, 1: 1}
    compared = spark.read.parquet(os.path.join(base, "mended"))
    assert compared.isEmpty()
    assert feed.read(spark).filter("id = 1000").select("kind").first().kind == "price_drop"


def test_only_runs_that_are_asked_for_are_read_again(spark):
    batches = [[row(i, i, 1000 - i) for i in range(1, 30)], [row(100, 3, 5)]]
    base = tempfile.mkdtemp(prefix="spark-")
    feed = play(spark, base, batches)
    assert [r.id for r in spark.read.parquet(os.path.join(base, "mended")).collect()] == [4]
    assert told(feed.read(spark)) == at_once(spark, batches)


def test_state_before_each_run():
    assert previous_states({3: (9, "c"), 1: (1, "a"), 2: (5, "b")}) == {1: None, 2: "a", 3: "b"}
    assert previous_states({}) == {}


class Store:
    """What an item's history costs: reads and writes of its state."""

    def __init__(self, held=None):
        self.held, self.read, self.written = held, 0, 0

    @property
    def exists(self):
        return self.held is not None

    @property
    def get(self):
        self.read += 1
        return self.held

    def update(self, value):
        self.held, self.written = value, self.written + 1


def test_histories_are_read_and_written_once_for_many_items():
    """However many items and runs meet in a share, its state goes to the worker and back as one value."""
    store = Store()

    def told(*rows):
        frame = pd.DataFrame(rows, columns=["profile_slug", "source_item_id", "run_id", "id", "state"])
        (found,) = run_history((7,), iter([frame[:2], frame[2:]]), store)
        assert list(found.columns) == ["k0", "k1", "run_id", "previous", "again"]
        return {tuple(r) for r in found.itertuples(index=False)}

    items = ["1", "ä", None]
    first = told(*[("p", item, run, run, f"s{run}") for item in items for run in range(1, 101)])
    assert first == {("p", item, run, f"s{run - 1}" if run > 1 else None, False) for item in items for run in range(1, 101)}
    assert (store.read, store.written) == (0, 1)
    # A newer row of run 50 mends run 51 of its item only; an older one of run 60 changes nothing.
    again = told(("p", None, 50, 500, "new"), ("p", "ä", 60, 5, "old"))
    assert again == {("p", None, 50, "s49", False), ("p", None, 51, "new", True), ("p", "ä", 60, "s59", False)}
    assert told(("p", "ä", 60, 6, "old")) == {("p", "ä", 60, "s59", False)}
    assert (store.read, store.written) == (2, 2)
