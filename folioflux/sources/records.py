"""Bibliographic records asked for by ISBN, including "asked, nothing known"."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators import ordered

FIELDS = ["title", "subtitle", "author", "series", "series_index", "language"]


def isbns_to_ask(log: DataFrame, asked: DataFrame, budget: int) -> DataFrame:
    """ISBNs seen but never asked for, the most recently seen first."""
    seen = (
        log.filter("isbn is not null")
        .groupBy("profile_slug", "isbn").agg(F.max("id").alias("last_seen"))
        .join(asked.select("isbn").distinct(), "isbn", "left_anti")
    )
    return ordered.top_per_key(
        seen.filter("isbn <> ''"), ["profile_slug"], [F.col("last_seen").desc()], budget
    )


def record_cache(answers: DataFrame) -> DataFrame:
    """Latest answer per ISBN; an empty answer keeps the fields of the one before."""
    seq = F.col("seq")
    hit = F.when(F.col("found"), seq)
    return answers.groupBy("isbn").agg(
        F.max_by("found", seq).alias("found"),
        *[F.max_by(f, hit).alias(f) for f in FIELDS if f in answers.columns],
        F.max("checked_at").alias("checked_at"),
    )


def record_edges(edges: DataFrame) -> DataFrame:
    return edges.select("isbn", "contained").distinct()


@dataclass
class Enrichment:
    """What one round of questions brings; ``asked`` holds an outcome for every ISBN."""

    asked: DataFrame
    records: DataFrame
    cache: DataFrame
    edges: DataFrame
    report: DataFrame


def until_throttled(work: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """The work list up to the first throttled answer of each key, with ``outcome``.

    Where the halt lies is a minimum over the list, so nothing is asked in order by one
    task. The throttled question itself was sent; whatever comes after it was not. An
    ISBN without any answer failed, which costs that one answer and does not halt.
    """
    halts = work.filter("throttled").groupBy(*keys).agg(F.min(rank).alias("_halt"))
    outcome = (
        F.when(F.coalesce("throttled", F.lit(False)), "throttled")
        .when(F.col("found").isNull(), "failed")
        .when(F.col("found"), "found")
        .otherwise("nothing")
    )
    return (
        work.join(halts, keys, "left")
        .filter(F.col("_halt").isNull() | (F.col(rank) <= F.col("_halt")))
        .drop("_halt")
        .withColumn("outcome", outcome)
    )


def enrich(
    log: DataFrame, known: DataFrame, answers: DataFrame, edges: DataFrame, budget: int,
    now: Column,
) -> Enrichment:
    """Ask for at most ``budget`` new ISBNs of a profile and keep what is answered.

    ``known`` is the record log so far (every ISBN in it was asked for, also where
    nothing was found), ``answers(isbn, throttled, found, fields…)`` what the library
    says. Found and "nothing known" are kept, so they are not asked again; throttled
    and failed questions leave no row and come up in a later run.
    """
    wanted = isbns_to_ask(log, known, budget)
    asked = until_throttled(wanted.join(answers, "isbn", "left"), ["profile_slug"])
    answered = asked.filter(F.col("outcome").isin("found", "nothing"))
    fields = [f for f in FIELDS if f in answers.columns]
    # Two profiles may have asked for one ISBN; its answer is the same.
    last = known.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    fresh = (
        answered.groupBy("isbn")
        .agg(F.max("last_seen").alias("_seen"), F.any_value("found").alias("found"),
             *[F.any_value(f).alias(f) for f in fields])
        .join(F.broadcast(last))  # one row: the newest number of the log
        .select("isbn", (F.col("_last") + F.col("_seen") + 1).alias("seq"), "found", *fields,
                now.alias("checked_at"))
    )
    found = fresh.filter("found").select("isbn")
    return Enrichment(
        asked=asked.select("profile_slug", "isbn", "rank", "outcome"),
        records=fresh,
        cache=record_cache(known.select(*fresh.columns).unionByName(fresh)),
        edges=record_edges(edges.join(found, "isbn", "left_semi")),
        report=asked.groupBy("profile_slug").agg(
            F.count("*").alias("asked"),
            F.count_if(F.col("outcome") == "found").alias("answered"),
            F.bool_or(F.col("outcome") == "throttled").alias("halted"),
        ),
    )
