"""Stored answers of catalogues as a Spark data source, and the collection over several.

A source that cannot be read leaves an error row; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflux.functions import catalogue

SCHEMA = (
    "source string, source_item_id string, title string, author string, isbn string, "
    "blurb string, error string"
)
FACTS = ["source_item_id", "title", "author", "isbn", "blurb"]


class Piece(InputPartition):
    """One row group of one file, or what kept the source from being listed."""

    def __init__(self, path: str = "", group: int = 0, error: str | None = None):
        super().__init__(None)
        self.path, self.group, self.error = path, group, error


class AnswersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.source = options["source"]
        self.path = options["path"]
        #: Column of the answer for each fact; facts it lacks are NULL.
        self.facts: dict[str, str] = json.loads(options.get("facts", "{}"))

    def _files(self):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        if "://" not in self.path and not self.path.startswith("file:"):
            return ds.dataset(self.path, format="parquet")
        files, path = FileSystem.from_uri(self.path)
        return ds.dataset(path, filesystem=files, format="parquet")

    def partitions(self) -> list[InputPartition]:
        try:
            pieces = [
                Piece(part.path, part.row_groups[0].id)
                for file in self._files().get_fragments()
                for part in file.split_by_row_group()
            ]
        except Exception as error:  # noqa: BLE001 - one source, not the run
            return [Piece(error=f"{type(error).__name__}: {error}")]
        # A source with nothing in it is no failure, but Spark wants a partition.
        return pieces or [Piece()]

    def read(self, partition: Piece) -> Iterator:
        """Rows of one piece. A piece that breaks is an error row and no half of its rows."""
        if partition.error is None and not partition.path:
            return
        if partition.error is not None:
            yield self._failure(partition.error)
            return
        try:
            batches = list(self._rows(partition))
        except Exception as error:  # noqa: BLE001 - one source, not the run
            batches = [self._failure(f"{type(error).__name__}: {error}")]
        yield from batches

    def _rows(self, piece: Piece) -> Iterator:
        import pyarrow as pa

        file = next(f for f in self._files().get_fragments() if f.path == piece.path)
        table = file.subset(row_group_ids=[piece.group]).to_table(columns=list(self.facts.values()))
        for batch in table.to_batches(max_chunksize=4096):
            nothing = pa.nulls(batch.num_rows, pa.string())
            facts = [
                batch.column(self.facts[f]).cast(pa.string()) if f in self.facts else nothing
                for f in FACTS
            ]
            name = pa.array([self.source] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([name, *facts, nothing], ["source", *FACTS, "error"])

    def _failure(self, message: str):
        import pyarrow as pa

        cells = [self.source, *[None] * len(FACTS), message]
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.string()) for cell in cells], ["source", *FACTS, "error"]
        )


class AnswersSource(DataSource):
    """``spark.read.format("answers")`` with the options source, path and facts (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AnswersReader(dict(self.options))


def collect(
    spark: SparkSession, sources: dict[str, tuple[str, dict[str, str]]]
) -> tuple[DataFrame, DataFrame]:
    """Items of all sources with clean blurbs, and one row for each failure.

    ``sources`` maps a name to its path and the column of each fact.
    """
    spark.dataSource.register(AnswersSource)
    frames = [
        spark.read.format("answers").option("source", name).option("path", path)
        .option("facts", json.dumps(facts)).load()
        for name, (path, facts) in sources.items()
    ]
    rows = reduce(DataFrame.unionByName, frames)
    items = rows.filter("error is null").drop("error")
    failures = rows.filter("error is not null").select("source", F.col("error").alias("message"))
    return items.withColumn("blurb", catalogue.clean_blurb(F.col("blurb"))), failures
