"""Runs, enrichment, seeding and repair of the stored data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.config import Profile, source_kind
from folioflux.functions import catalogue
from folioflux.operators import bundles, changes, linkage, ordered, state
from folioflux.operators.changes import ITEM
from folioflux.plans import gate
from folioflux.session import materialize
from folioflux.sources import sinks


def fill_blurbs(finds: DataFrame, details: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace cut or missing blurbs by the detail record's; take its cover if there is one."""
    lacking = F.col("blurb").isNull() | catalogue.is_truncated(F.col("blurb"))
    return (
        finds.join(details, list(keys), "left")
        .withColumn("blurb", F.when(lacking, F.coalesce("detail_blurb", "blurb")).otherwise(F.col("blurb")))
        .withColumn("cover_url", F.coalesce("detail_cover", "cover_url"))
        .drop("detail_blurb", "detail_cover")
    )


def newest_for_judgement(log: DataFrame, books: DataFrame) -> DataFrame:
    """Newest observation per profile and book, with the book's blurb where its own is cut."""
    newest = ordered.latest(log.filter("book_id is not null"), ["profile_slug", "book_id"])
    lacking = F.coalesce(F.length("blurb"), F.lit(0)) == 0
    lacking = lacking | catalogue.is_truncated(F.col("blurb"))
    return (
        newest.join(books.select("book_id", F.col("blurb").alias("_of_book")), "book_id", "left")
        .withColumn(
            "blurb",
            F.when(lacking & (F.length("_of_book") > 0), F.col("_of_book")).otherwise(F.col("blurb")),
        )
        .drop("_of_book")
    )


# ------------------------------------------------------------------------- run


def _as_it_is(name: str, frame: DataFrame) -> DataFrame:
    return frame


RUN_KEY = ["profile_slug", "run_id"]
#: In the order in which they are written: history first, judgements after it.
RUN_FRAMES = [
    "rows", "learned", "foreign", "deltas", "decided", "seeded", "digest", "report", "journal",
]


@dataclass
class Run:
    """One run: state before, changes, snapshot, side facts, gate, digest and journal.

    Each frame is made when it is first asked for. ``log`` holds earlier runs only, so
    the previous state is read before the snapshot exists. The snapshot does not depend
    on the gate: a failing judgement costs a judgement and never history. Interests of a
    failed source stay unseeded; ``failed(source, message)`` names those sources.
    ``keep(name, frame)`` may write a frame and give back what it wrote
    (``sinks.RunWriter.keep``), so later frames do not compute earlier ones again.
    """

    observations: DataFrame
    log: DataFrame
    books: DataFrame
    ratings: DataFrame
    edges: DataFrame
    origin: DataFrame
    seeded_before: DataFrame
    swept: DataFrame
    attention: DataFrame
    failures: DataFrame
    failed: DataFrame
    profile: Profile
    run_time: Column
    rate: Callable[[DataFrame], DataFrame] | None = None
    keep: Callable[[str, DataFrame], DataFrame] = _as_it_is

    @cached_property
    def rows(self) -> DataFrame:
        return self.keep("rows", sinks.observation_rows(self.observations, self.run_time))

    @cached_property
    def learned(self) -> DataFrame:
        seen = self.observations.select("id", "book_id", "isbn")
        return self.keep("learned", linkage.learn_isbns(self.books, seen))

    @cached_property
    def foreign(self) -> DataFrame:
        return self.keep("foreign", sinks.foreign_ratings(self.observations))

    @cached_property
    def deltas(self) -> DataFrame:
        # Single prices come from what is stored, not from this run.
        title_prices, isbn_prices, stored = bundles.price_lists(
            self.log, F.max_by(F.struct(*changes.STATE), "id").alias("_state")
        )
        latest = stored.select(*ITEM, "_state.*")
        compared = changes.with_stored_previous(self.observations, latest)
        compared = bundles.with_advantage(
            compared, title_prices, isbn_prices, self.edges, self.profile,
            keys_from=self.observations,
        )
        found = changes.changes(compared, self.profile, F.col("advantage").isNotNull())
        told = changes.suppress_unseeded(changes.notifiable(found), self.origin, self.seeded_before)
        return self.keep("deltas", told)

    @cached_property
    def decided(self) -> DataFrame:
        return self.keep(
            "decided", gate.apply(self.deltas, self.ratings, self.profile, RUN_KEY, self.rate)
        )

    @cached_property
    def seeded(self) -> DataFrame:
        healthy = self.swept.join(self.failed.select("source"), "source", "left_anti")
        marks = healthy.select("interest_id", "source", self.run_time.alias("seeded_at"))
        return self.keep("seeded", marks.distinct())

    @cached_property
    def digest(self) -> DataFrame:
        shown = self.decided.filter("shown")
        return self.keep("digest", sinks.digest(shown, self.attention, self.failures, self.profile))

    @cached_property
    def report(self) -> DataFrame:
        counts = self.decided.groupBy(*RUN_KEY).agg(
            F.count_if("shown").alias("shown"), F.count("*").alias("deltas")
        )
        if self.rate is not None:
            counts = counts.join(gate.report(self.decided, RUN_KEY), RUN_KEY)
        return self.keep("report", counts)

    @cached_property
    def journal(self) -> DataFrame:
        runs = self.observations.select(*RUN_KEY).distinct()
        rows = run_journal_rows(runs, self.report, self.failed, self.run_time)
        return self.keep("journal", rows)

    def write(self) -> None:
        """Make all frames in order; with a writer's ``keep`` each is written once."""
        for name in RUN_FRAMES:
            getattr(self, name)


def collecting_sources(
    observations: DataFrame, switches: DataFrame, probes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sources a run asks (switched on, last probe good), and those that failed theirs."""
    on = state.enabled(observations.select("source").distinct(), switches).filter("enabled")
    last = state.last_probe(probes)
    # A row a source, written: both frames are read many times.
    probed = materialize(on.select("source").join(last, "source", "left"), "probed-sources")
    failed = F.col("last_ok") == F.lit(False)
    return (
        probed.filter(F.coalesce(~failed, F.lit(True))).select("source"),
        probed.filter(failed).select("source", F.col("last_error").alias("message")),
    )


def run_journal_rows(runs: DataFrame, counts: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """The closing row of each run: an error where a source failed, and what it said."""
    # One message a source, so the text is as long as the list of sources.
    said = failed.groupBy("source").agg(F.max("message").alias("message")).agg(
        F.array_join(
            F.sort_array(F.collect_list(F.concat_ws(": ", "source", "message"))), "; "
        ).alias("_said")
    )
    by = ["profile_slug", "run_id"]
    return (
        runs.join(counts.select(*by, "shown"), by, "left")
        .join(F.broadcast(said))  # one row
        .select(
            *by, now.alias("finished_at"),
            F.when(F.col("_said") == "", "ok").otherwise("error").alias("status"),
            F.coalesce("shown", F.lit(0)).alias("delta_count"),
            F.nullif("_said", F.lit("")).alias("error"),
        )
    )


def healthy_sources(observations: DataFrame) -> DataFrame:
    """Probe of the sources as a check of what they delivered.

    A source fails when it brought nothing with a price or a row without a title.
    """
    return observations.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.count("price_cents").alias("priced"),
        F.count_if(F.coalesce(F.col("title"), F.lit("")) == "").alias("broken"),
    ).withColumn("ok", (F.col("priced") > 0) & (F.col("broken") == 0))


def one_entry(observations: DataFrame, entry: Column) -> DataFrame:
    """Rows of a run for one entry: collected and stored, but not compared."""
    return observations.filter(entry & (F.col("match_reason") == "watchlist"))


def entry_runs(
    requests: DataFrame, entries: DataFrame, observations: DataFrame, links: DataFrame,
    sources: DataFrame, failed: DataFrame, profile: Profile, now: Column,
) -> tuple[DataFrame, DataFrame]:
    """Runs for one entry each: what they collected, and their journal.

    ``requests(request_id, profile_slug, book_id)``; ``entries(profile_slug, book_id,
    active, restriction)``; ``sources(source)`` are switched on and well,
    ``failed(source, message)`` switched on but failing. A request without an entry or
    for a paused one, and one that no source is left for, ends at once with its
    trouble. A failing source costs its own answer only.
    """
    asked = requests.join(
        entries.select("profile_slug", "book_id", "active", "restriction"),
        ["profile_slug", "book_id"], "left",
    )
    kind = source_kind(profile, F.col("source"))
    open_ = asked.filter("active")
    wanted = open_.join(
        links.filter("source_item_id is not null").select("book_id", "source", "source_item_id"), "book_id"
    ).filter(F.coalesce(F.col("restriction") == kind, F.lit(True)))
    collected = wanted.join(sources.select("source"), "source", "left_semi").join(observations, ITEM)
    counts = collected.groupBy("request_id").agg(F.count("*").alias("_found"))
    # Configuration of a few names: one row of sorted trouble, one of the number asked.
    said = failed.agg(
        F.array_join(F.sort_array(F.collect_list("source")), "; ").alias("_said"),
        F.count("*").alias("_bad"),
    )
    well = sources.agg(F.count("*").alias("_well"))
    trouble = (
        F.when(F.col("active").isNull(), "no entry")
        .when(~F.col("active"), "paused")
        .when(F.col("_well") + F.col("_bad") == 0, "no source")
        .otherwise(F.nullif("_said", F.lit("")))
    )
    ran = F.coalesce("active", F.lit(False)) & (F.col("_well") + F.col("_bad") > 0)
    journal = (
        asked.join(counts, "request_id", "left")
        .join(F.broadcast(said)).join(F.broadcast(well))  # one row each
        .select(
            "request_id", "profile_slug", "book_id",
            F.lit("entry").alias("run_trigger"), now.alias("started_at"),
            F.when(~ran, "refused").when(F.col("_bad") > 0, "failed").otherwise("ok").alias("status"),
            F.coalesce("_found", F.lit(0)).alias("delta_count"), trouble.alias("trouble"),
        )
    )
    return collected, journal


# ------------------------------------------------------------------------ seed


def seed_rows(
    watchlist: DataFrame, liked: DataFrame, owned: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Titles to be linked to books with the relation they carry, and unreadable lines.

    ``watchlist(profile_slug, item_id, title, author, check_library, check_shop,
    active, note)``, ``liked(profile_slug, item_id, kind, line)`` as free text,
    ``owned(profile_slug, item_id, title, author, stars, note)``.
    """
    restriction = F.when(
        F.col("check_library") != F.col("check_shop"),
        F.when(F.col("check_library"), "library").otherwise("shop"),
    )
    none = F.lit(None)
    watched = watchlist.select(
        "profile_slug", "item_id", "title", "author", F.lit("watching").alias("kind"), "active",
        restriction.alias("restriction"), "note", none.cast("int").alias("stars"),
    )
    split = liked.withColumn("p", catalogue.free_text_parts(F.col("line")))
    readable = (F.col("p.title") != "") & F.col("p.author").isNotNull()
    opinions = split.filter(readable).select(
        "profile_slug", "item_id", "p.title", "p.author", "kind", F.lit(True).alias("active"),
        none.cast("string").alias("restriction"), "p.note", none.cast("int").alias("stars"),
    )
    mine = owned.select(
        "profile_slug", "item_id", "title", "author", F.lit("owned").alias("kind"),
        F.lit(True).alias("active"), none.cast("string").alias("restriction"), "note", "stars",
    )
    rows = watched.unionByName(opinions).unionByName(mine)
    return rows, split.filter(~readable).select("profile_slug", "kind", "line")


def seed_report(rows: DataFrame, unresolved: DataFrame, interests: DataFrame) -> DataFrame:
    """Counts per profile of what a seed brings."""
    counts = rows.groupBy("profile_slug").agg(
        F.count("*").alias("relations"), F.count("stars").alias("ratings")
    )
    lost = unresolved.groupBy("profile_slug").agg(F.count("*").alias("unresolved"))
    wanted = interests.groupBy("profile_slug").agg(F.count("*").alias("interests"))
    return (
        counts.join(lost, "profile_slug", "left").join(wanted, "profile_slug", "left")
        .fillna(0, ["unresolved", "interests"])
    )


# ---------------------------------------------------------------------- repair


def repaired_blurbs(rows: DataFrame) -> DataFrame:
    """Blurbs once instead of twice, and without leftover controls."""
    return rows.withColumn(
        "blurb", catalogue.clean_blurb(catalogue.without_teaser(F.col("blurb")))
    )


def renamed_source(rows: DataFrame, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """Rename a source in keyed rows; where the new key exists already, its row stays."""
    moved = rows.withColumn("_moved", F.col("source") == old).withColumn(
        "source", F.when(F.col("source") == old, new).otherwise(F.col("source"))
    )
    return ordered.first(moved, list(keys), ["_moved", "seq"]).drop("_moved")


def renamed_keys(
    ratings: DataFrame, source: tuple[str, str] | None = None, origin: tuple[str, str] | None = None
) -> DataFrame:
    """Ratings of a renamed source or origin; a rating already under the new key wins."""
    subject, who = F.col("subject"), F.col("origin")
    if source:
        prefix = f"item:{source[0]}:"
        rest = F.substr(subject, F.lit(len(prefix) + 1))
        subject = F.when(
            subject.startswith(prefix), F.concat(F.lit(f"item:{source[1]}:"), rest)
        ).otherwise(subject)
    if origin:
        who = F.when(who == origin[0], origin[1]).otherwise(who)
    moved = ratings.withColumns({"_subject": subject, "_origin": who}).withColumn(
        "_moved", (F.col("_subject") != F.col("subject")) | (F.col("_origin") != F.col("origin"))
    )
    renamed = moved.drop("subject", "origin").withColumnsRenamed(
        {"_subject": "subject", "_origin": "origin"}
    )
    return ordered.first(renamed, ["subject", "origin"], ["_moved", "seq"]).drop("_moved")


# ---------------------------------------------------------------------- covers


def covers_to_fetch(
    questions: DataFrame, suggestions: DataFrame, of_books: DataFrame, stored: DataFrame
) -> DataFrame:
    """Cover addresses of open questions, suggestions and books not stored yet."""
    urls = (
        questions.select("cover_url").unionByName(suggestions.select("cover_url"))
        .unionByName(of_books.select("cover_url"))
        .filter("length(cover_url) > 0").distinct()
    )
    return urls.withColumn("file", catalogue.file_name(F.col("cover_url"))).join(
        stored.select("file"), "file", "left_anti"
    )


def first_cover_per_book(log: DataFrame, books: DataFrame) -> DataFrame:
    """First observed cover of every book without one."""
    bare = books.filter("cover_file is null").select("book_id")
    seen = log.filter("book_id is not null and cover_url is not null").join(bare, "book_id", "left_semi")
    return ordered.first(seen.select("book_id", "cover_url", "id"), ["book_id"], ["id"])


# --------------------------------------------------------------- source plug-ins

SourceReader = Callable[[SparkSession, dict], DataFrame]
_READERS: dict[str, SourceReader] = {}


def register_source(name: str, reader: SourceReader) -> None:
    """A source is a function from a session and its options to observations."""
    _READERS[name] = reader


def read_sources(spark: SparkSession, options: dict[str, dict]) -> DataFrame:
    """Union of the configured sources."""
    frames = [_READERS[name](spark, opts).withColumn("source", F.lit(name)) for name, opts in options.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
