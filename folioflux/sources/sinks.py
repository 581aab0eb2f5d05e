"""What a run writes: observations, blurbs, foreign ratings and the digest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions import catalogue, rules

# ---------------------------------------------------------------- fixed values
SECTIONS = [
    "Bibliothek", "Watchlist — Preise", "Neue Titel deiner Autor:innen",
    "Genre-Vorschläge (unsicher)", "Braucht Aufmerksamkeit", "⚠️ Fehler",
]
FOREIGN_ORIGIN = "onleihe_readers"
# ------------------------------------------------------------------------------


def observation_rows(observations: DataFrame, run_time: Column) -> DataFrame:
    """Rows as the log stores them: no blurb where the book keeps it, a time for all."""
    return observations.withColumn(
        "blurb", F.when(F.col("book_id").isNull(), F.col("blurb"))
    ).withColumn("observed_at", F.coalesce("observed_at", run_time))


def append_run(rows: DataFrame, path: str) -> None:
    """Append one run to the log; running it again replaces only its own partitions."""
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("profile_slug", "run_id").parquet(path)
    )


MANIFEST = "run_id long, attempt int, frames array<string>"


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


class RunWriter:
    """All frames of one run under its id; they count once the manifest names them.

    Every frame goes to ``<base>/<frame>/run_id=<id>/attempt=<n>``. ``commit`` appends
    one row to the manifest, last of all. A run that breaks before leaves folders nobody
    reads; its repetition has the same attempt number and overwrites them. A committed
    run that is repeated gets the next number, so its old frames stay whole until the
    new ones are. One writer a run at a time.
    """

    def __init__(self, spark: SparkSession, base: str, run_id: int):
        self.spark, self.base, self.run_id = spark, base, run_id
        done = _manifest(spark, base).filter(F.col("run_id") == run_id).agg(F.max("attempt"))
        self.attempt = (done.first()[0] or 0) + 1
        self.frames: list[str] = []

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        """Write one frame and give back what was written, with its ``run_id``."""
        path = f"{self.base}/{name}/run_id={self.run_id}/attempt={self.attempt}"
        frame.drop("run_id").write.mode("overwrite").parquet(path)
        self.frames.append(name)
        kept = self.spark.read.schema(frame.drop("run_id").schema).parquet(path)
        if "run_id" not in frame.columns:
            return kept
        kind = frame.schema["run_id"].dataType
        return kept.withColumn("run_id", F.lit(self.run_id).cast(kind)).select(*frame.columns)

    def commit(self) -> None:
        row = self.spark.createDataFrame([(self.run_id, self.attempt, self.frames)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/manifest")


def committed(spark: SparkSession, base: str, name: str, run_id: int | None = None) -> DataFrame:
    """A frame of all committed runs, or of one; other runs' folders are pruned."""
    done = _manifest(spark, base)
    whole = spark.read.parquet(f"{base}/{name}")
    if run_id is not None:
        done = done.filter(F.col("run_id") == run_id)
        whole = whole.filter(F.col("run_id") == run_id)
    last = done.filter(F.array_contains("frames", name)).groupBy("run_id").agg(
        F.max("attempt").alias("attempt")
    )
    return whole.join(last, ["run_id", "attempt"], "left_semi").drop("attempt")


def remembered_blurbs(books: DataFrame, observations: DataFrame) -> DataFrame:
    """Books with the longest blurb seen; it has to be strictly longer than the old one."""
    longest = (
        observations.filter("book_id is not null and length(blurb) > 0")
        .groupBy("book_id")
        .agg(F.max_by("blurb", F.struct(F.length("blurb"), -F.col("id"))).alias("_new"))
    )
    old = F.coalesce(F.length("blurb"), F.lit(0))
    return (
        books.join(longest, "book_id", "left")
        .withColumn("blurb", F.when(F.length("_new") > old, F.col("_new")).otherwise(F.col("blurb")))
        .drop("_new")
    )


def foreign_ratings(observations: DataFrame) -> DataFrame:
    """Averages of a source's readers, where votes say what they rest on."""
    voted = observations.filter("rating is not null and rating_votes > 0").withColumn(
        "subject", catalogue.subject_of(F.col("isbn"), F.col("source"), F.col("source_item_id"))
    )
    last = voted.groupBy("subject").agg(F.max_by(F.struct("rating", "rating_votes"), "id").alias("r"))
    return last.select(
        "subject",
        F.lit(FOREIGN_ORIGIN).alias("origin"),
        F.col("r.rating").cast("double").alias("stars"),
        F.lit("belegt").alias("confidence"),
        F.format_string("Durchschnitt der Leser:innen aus %d Stimmen", F.col("r.rating_votes")).alias("reason"),
        F.lit(0).alias("profile_version"),
        F.col("r.rating_votes").alias("votes"),
    )


def digest(
    deltas: DataFrame, attention: DataFrame, failures: DataFrame, profile: Profile
) -> DataFrame:
    """Entries of a digest with the rank of their section; empty sections have no rows.

    ``deltas`` carries ``previous``, ``advantage`` (or NULL) and ``position``. Sort
    by ``(section_rank, id, position)`` to read it.
    """
    kind, reason = F.col("kind"), F.col("match_reason")
    price, before = F.col("price_cents"), F.col("previous.price_cents")
    waiting = F.col("previous.reservation_count")
    section = F.when(kind == "became_available", 1).otherwise(
        F.when(reason == "watchlist", 2).when(reason == "profile_author", 3).otherwise(4)
    )
    plain = F.when(
        kind == "first_seen",
        F.concat(
            catalogue.why_shown(reason, F.col("author"), F.col("category")),
            F.coalesce(F.concat(F.lit(" · "), catalogue.money(price)), F.lit("")),
        ),
    ).otherwise(F.concat(catalogue.money(before, "—"), F.lit(" → "), catalogue.money(price, "—")))
    saving = F.when(
        F.col("advantage").isNotNull(),
        F.concat(
            catalogue.bundle_sentence(
                F.col("advantage.volumes"), price, F.col("advantage.singles"), F.col("advantage.saved_pct")
            ),
            F.lit(" · "),
        ),
    )
    detail = F.when(
        kind == "became_available",
        F.concat(
            F.lit("jetzt verfügbar"),
            F.when(
                waiting > 0,
                F.concat(F.lit(" (zuvor "), waiting.cast("string"), F.lit(" Vormerkungen)")),
            ).otherwise(""),
        ),
    ).otherwise(F.concat(F.coalesce(saving, F.lit("")), plain))
    flag = F.when(
        kind != "became_available",
        rules.deal_label(price, F.col("original_price_cents"), before, profile),
    )
    none = F.lit(None).cast("string")
    changes = deltas.select(
        section.alias("section_rank"), F.col("id"), F.col("position"), "title", "author",
        detail.alias("detail"), flag.alias("flag"), "url",
    )
    questions = attention.select(
        F.lit(5).alias("section_rank"), F.col("id"), F.lit(0).alias("position"),
        F.col("entry_title").alias("title"), F.col("entry_author").alias("author"),
        F.concat(
            F.concat_ws(": ", "source", "reason"),
            F.coalesce(F.concat(F.lit(" — bester Treffer: „"), "best_guess", F.lit("“")), F.lit("")),
        ).alias("detail"),
        none.alias("flag"), F.col("best_guess_url").alias("url"),
    )
    errors = failures.select(
        F.lit(6).alias("section_rank"), F.col("id"), F.lit(0).alias("position"),
        F.col("source").alias("title"), none.alias("author"), F.col("message").alias("detail"),
        none.alias("flag"), none.alias("url"),
    )
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return (
        changes.unionByName(questions).unionByName(errors)
        .withColumn("section", F.get(names, F.col("section_rank") - 1))
    )
