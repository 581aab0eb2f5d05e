"""JSON answers of a catalogue: title records and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue

ITEM = (
    "struct<id:string,title:string,firstCreatorName:string,ownedCopies:string,"
    "availableCopies:string,holdsCount:string,formats:array<struct<isbn:string>>,"
    "covers:struct<cover510Wide:struct<href:string>,cover300Wide:struct<href:string>>,"
    "description:string>"
)


def _text(value: Column) -> Column:
    return catalogue.empty_to_null(F.trim(value))


def _isbn(formats: Column) -> Column:
    """The first format that carries an ISBN."""
    found = F.transform(formats, lambda f: catalogue.isbn_in_text(f["isbn"]))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _count(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+$"), value.cast("int"))


def title_records(answers: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed records and the answers with a structure error (a missing count or title)."""
    rest = [c for c in answers.columns if c != column]
    item = F.from_json(column, ITEM)
    rows = answers.select(*rest, item.alias("i")).select(
        *rest,
        F.col("i.id").alias("source_item_id"),
        _text(F.col("i.title")).alias("title"),
        _text(F.col("i.firstCreatorName")).alias("author"),
        _isbn(F.col("i.formats")).alias("isbn"),
        _count(F.col("i.ownedCopies")).alias("owned_copies"),
        _count(F.col("i.availableCopies")).alias("available_copies"),
        _count(F.col("i.holdsCount")).alias("reservation_count"),
        _text(F.col("i.description")).alias("blurb"),
        F.coalesce("i.covers.cover510Wide.href", "i.covers.cover300Wide.href").alias("cover_url"),
    )
    error = (
        F.when(F.col("title").isNull(), "no title")
        .when(F.col("owned_copies").isNull(), "no ownedCopies")
        .when(F.col("available_copies").isNull(), "no availableCopies")
        .when(F.col("reservation_count").isNull(), "no holdsCount")
    )
    marked = rows.withColumn("error", error).withColumn(
        "availability",
        catalogue.availability_of_copies(F.col("owned_copies"), F.col("available_copies")),
    )
    return (
        marked.filter("error is null").drop("error"),
        marked.filter("error is not null").select(*rest, "source_item_id", "error"),
    )


def search_results(answers: DataFrame, column: str = "value") -> DataFrame:
    """One row per hit with its place; answers without hits keep one row and a status."""
    rest = [c for c in answers.columns if c != column]
    items = F.from_json(column, f"struct<items:array<{ITEM}>>")["items"]
    rows = answers.select(*rest, items.alias("items"))
    status = F.when(F.col("items").isNull(), "error").when(F.size("items") == 0, "none").otherwise("hits")
    return (
        rows.withColumn("status", status)
        .select(*rest, "status", F.posexplode_outer("items").alias("rank", "i"))
        .select(
            *rest,
            F.when(
                (F.col("status") == "hits") & (_text(F.col("i.title")).isNull() | _text(F.col("i.id")).isNull()),
                "error",
            ).otherwise(F.col("status")).alias("status"),
            "rank",
            F.col("i.id").alias("title_id"),
            _text(F.col("i.title")).alias("title"),
            _text(F.col("i.firstCreatorName")).alias("author"),
            _isbn(F.col("i.formats")).alias("isbn"),
        )
    )
