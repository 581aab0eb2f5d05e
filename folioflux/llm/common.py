"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.session import shared_folder, ship_package

#: Rows that are turned into Python objects at once.
ROWS_AT_ONCE = 512
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: White space between words, fixed by the contracts of the operators.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly these columns under these names, whatever else the table holds."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces small enough for Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    It outlives lost executors and cuts the lineage of what follows.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Let the Python workers import this package, and hand them texts in small batches.

    Texts may be long: a batch of the default size would hold tens of megabytes, several
    times over, in each worker and in the executor beside it.
    """
    ship_package(spark)
    spark.conf.set(ROWS_A_BATCH, ROWS_AT_ONCE)


def fan_out(spark: SparkSession) -> int:
    """Into how many parts a hot key is split; it follows the cluster's setting."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def run_id() -> str:
    return uuid.uuid4().hex
