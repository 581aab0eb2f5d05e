"""Streams over the observation log, played to the end."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import rules
from folioflux.session import shared_folder
from folioflux.streaming.feed import ChangeFeed, observations
from folioflux.workload import sqltext as S
from folioflux.workload.changes import _feed_sql
from folioflux.workload.registry import query
from folioflux.workload.tables import PROFILE

c = F.col


def _play(t, parts: int, whole_runs: bool, log: bool) -> tuple[ChangeFeed, str]:
    """Let the log arrive in ``parts`` steps and run the feed after each of them."""
    base = shared_folder(t.spark, "feed")
    last = t.obs.agg(F.max("run_id" if whole_runs else "id").alias("_last"))
    step = c("run_id" if whole_runs else "id") * parts / (c("_last") + 1)
    # One row holds the greatest number.
    cut = t.obs.join(F.broadcast(last)).withColumn("_part", F.floor(step)).drop("_last")
    feed = ChangeFeed(base, PROFILE, os.path.join(base, "log") if log else None)
    for part in range(parts):
        cut.filter(c("_part") == part).drop("_part").write.parquet(
            os.path.join(base, "in", str(part))
        )
        stream = observations(t.spark, os.path.join(base, "in"), t.obs.schema)
        feed.start(stream, os.path.join(base, "checkpoint")).awaitTermination()
    return feed, base


@query("str_01_change_feed_stream", _feed_sql(S.announce(), "id, kind"))
def _(t) -> DataFrame:
    # The cuts fall inside runs, so one run spreads over two micro-batches.
    feed, _ = _play(t, 3, whole_runs=False, log=False)
    return feed.read(t.spark).select("id", "kind")


@query("str_02_run_loop", "SELECT profile_slug, run_id, id, source FROM obs")
def _(t) -> DataFrame:
    _, base = _play(t, 2, whole_runs=True, log=True)
    return t.spark.read.parquet(os.path.join(base, "log")).select(
        "profile_slug", "run_id", "id", "source"
    )


@query(
    "str_02_run_loop_changes",
    f"SELECT id, kind FROM ({_feed_sql(S.announce(), 'id, kind')}) WHERE kind IN ('first_seen', 'became_available', 'price_drop')",
)
def _(t) -> DataFrame:
    feed, _ = _play(t, 2, whole_runs=True, log=True)
    return feed.read(t.spark).filter(c("kind").isin(rules.NOTIFIABLE)).select("id", "kind")
