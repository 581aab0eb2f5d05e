"""The documents' way to training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``, and any others that came with them.

Defined cases: a null text counts as empty and stays null while its row stays; an empty
table goes through all stages and gives no piece; of rows that are equal throughout one
stays from near_dedup on; very long texts are read whole. A document whose lines were all
repeats goes with line_dedup, and rows without a text that is left are near copies of one
another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm import decontam, line_dedup, packing, pu_classifier, simhash
from folioflux.llm.common import fresh, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return pu_classifier.only_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents that they were all of.

    ``n_chars`` follows the shortened text.
    """
    count = fresh(docs, "_lines_removed")
    short = line_dedup.remove_repeated(docs, count)
    short = short.where((F.col(count) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars"))
        short = short.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return short.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.only_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, each with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier and the packing plan have no SQL. Tests hold the operators of the stages
#: against plain versions, and the stages together against what each must leave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
