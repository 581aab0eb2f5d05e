"""Keyed state as append-only change logs and their reduction to the latest state.

Nothing is updated in place. A write appends rows with a growing ``seq``; reading
reduces them per key with aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.operators.ordered import latest

RELATION_KEY = ["profile_slug", "book_id", "kind"]


def relations(log: DataFrame) -> DataFrame:
    """Current relations; details survive rows that bring none."""
    seq = F.col("seq")
    return log.groupBy(*RELATION_KEY).agg(
        F.max_by("active", seq).alias("active"),
        F.max_by("details", F.when(F.col("details").isNotNull(), seq)).alias("details"),
        F.min("created_at").alias("created_at"),
        F.min(seq).alias("first_seq"),
    )


def interests(log: DataFrame) -> DataFrame:
    seq = F.col("seq")
    return log.groupBy("profile_slug", "interest_key", "value").agg(
        F.max_by("active", seq).alias("active"),
        F.max_by("tier", F.when(F.col("tier").isNotNull(), seq)).alias("tier"),
        F.min(seq).alias("interest_id"),
    )


def seeded(marks: DataFrame) -> DataFrame:
    """First sweep per interest and source; later marks change nothing."""
    return marks.groupBy("interest_id", "source").agg(F.min("seeded_at").alias("seeded_at"))


def ratings(log: DataFrame) -> DataFrame:
    """Current ratings; a withdrawn one disappears."""
    return latest(log, ["subject", "origin"], "seq").filter("not withdrawn").drop("withdrawn")


def rejected_origins(log: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return log.filter(F.col("origin").isNull() | ~F.col("origin").isin(list(allowed)))


def links(log: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """Current link per book and source; a rename drops the links before it."""
    current = latest(log, ["book_id", "source"], "seq")
    if renames is None:
        return current
    last = effective_renames(renames).groupBy("book_id").agg(F.max("seq").alias("_renamed"))
    return (
        current.join(last, "book_id", "left")
        .filter(F.col("_renamed").isNull() | (F.col("seq") > F.col("_renamed")))
        .drop("_renamed")
    )


def effective_renames(renames: DataFrame) -> DataFrame:
    """Renames with a title; blank ones do nothing."""
    return renames.withColumn("title", F.trim("title")).filter("title <> ''")


def rename_books(books: DataFrame, renames: DataFrame) -> DataFrame:
    """Latest name per book; an author is replaced only where the rename gives one."""
    seq = F.col("seq")
    last = (
        effective_renames(renames)
        .groupBy("book_id")
        .agg(
            F.max_by("title", seq).alias("_title"),
            F.max_by(F.struct("author"), F.when(F.col("author").isNotNull(), seq)).alias("_author"),
        )
    )
    return (
        books.join(last, "book_id", "left")
        .withColumn("title", F.coalesce("_title", "title"))
        .withColumn(
            "author",
            F.when(F.col("_author").isNotNull(), F.nullif(F.trim("_author.author"), F.lit("")))
            .otherwise(F.col("author")),
        )
        .drop("_title", "_author")
    )


def rejected_candidates(ops: DataFrame) -> DataFrame:
    """Rejected addresses per (book, source) from a log of reject / undo / restore.

    ``restore`` and a new link clear everything before them.
    """
    key = ["book_id", "source"]
    cleared = (
        ops.filter(F.col("op").isin("restore", "link"))
        .groupBy(*key)
        .agg(F.max("seq").alias("_cleared"))
    )
    last = (
        ops.filter(F.col("op").isin("reject", "undo") & (F.length("url") > 0))
        .groupBy(*key, "url")
        .agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    )
    return (
        last.join(cleared, key, "left")
        .filter(
            (F.col("op") == "reject")
            & (F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
        )
        .select(*key, "url")
    )


def finish_commands(commands: DataFrame) -> DataFrame:
    """One command (owned or dismissed) becomes two log rows: it on, watching off."""
    rows = F.array(
        F.struct(F.col("kind").alias("kind"), F.lit(True).alias("active")),
        F.struct(F.lit("watching").alias("kind"), F.lit(False).alias("active")),
    )
    others = [c for c in commands.columns if c != "kind"]
    return commands.filter(F.col("kind").isin("owned", "dismissed")).select(
        *others, F.posexplode(rows).alias("part", "_row")
    ).select(*others, "part", "_row.*")


def enabled(names: DataFrame, switches: DataFrame) -> DataFrame:
    """Sources with their switch; a source nobody switched is on."""
    last = latest(switches, ["source"], "seq").select("source", "enabled")
    return names.join(last, "source", "left").withColumn(
        "enabled", F.coalesce("enabled", F.lit(True))
    )


def run_journal(events: DataFrame) -> DataFrame:
    """Start and finish events of runs, one row per run."""
    return events.groupBy("profile_slug", "run_id").agg(
        F.max(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished_at"),
        F.coalesce(F.max(F.when(F.col("event") == "finish", F.col("status"))), F.lit("running"))
        .alias("status"),
        F.max(F.when(F.col("event") == "finish", F.col("delta_count"))).alias("delta_count"),
    )


def merge_detail(current: DataFrame, key: str, value: str) -> DataFrame:
    """Set one key of the JSON bag ``details`` to the column ``value``."""
    bag = F.coalesce(
        F.from_json("details", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    kept = F.map_filter(bag, lambda k, v: (k != key) & v.isNotNull())
    return current.withColumn(
        "details", F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.col(value))))
    )


def last_probe(probes: DataFrame) -> DataFrame:
    """Last probe per source and what it said, in one pass."""
    return probes.groupBy("source").agg(
        F.max_by("ok", "seq").alias("last_ok"), F.max_by("error", "seq").alias("last_error")
    )


def probe_state(probes: DataFrame) -> DataFrame:
    """Last probe and number of failures since the last success, per source."""
    last_ok = probes.filter("ok").groupBy("source").agg(F.max("seq").alias("_last_ok"))
    joined = probes.join(last_ok, "source", "left")
    return joined.groupBy("source").agg(
        F.max_by("ok", "seq").alias("last_ok"),
        F.max_by("error", "seq").alias("last_error"),
        F.max("probed_at").alias("last_probe"),
        F.count_if(~F.col("ok") & (F.col("seq") > F.coalesce("_last_ok", F.lit(-1)))).alias(
            "failures"
        ),
    )
