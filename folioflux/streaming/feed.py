"""The change feed over a stream of observations.

A run is not a micro-batch: all rows of a run are compared with the last state of earlier
runs, however the run is spread over micro-batches, and a row that comes late mends its
run and the one after it. Spark's state store holds the newest state of each item in each
run (``history``); rows reach it reduced to one per item and run, so a hot item sends few.
The rows themselves do not pass through the state: they come along beside it in the same
micro-batch and meet it again in a join.

A micro-batch writes its own rows and comparisons under its number; where it changes the
state before rows of earlier micro-batches, those rows are read back (their runs only) and
compared again, and ``read`` takes the last comparison of each row. A repeated micro-batch
replaces its own output and starts from the state before it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from folioflux.config import Profile
from folioflux.operators import changes
from folioflux.operators.changes import ITEM, STATE
from folioflux.session import ship_package
from folioflux.sources import sinks
from folioflux.streaming.history import HISTORY, SHARES, newest_in_batch, run_history

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _same_item(a: str, b: str) -> Column:
    on = F.lit(True)
    for name in (*ITEM, "run_id"):
        on &= F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return on


@dataclass
class ChangeFeed:
    """Micro-batch function with its folders on storage all executors share."""

    base: str
    profile: Profile
    #: Where to append the observations as well; None keeps only the feed.
    log: str | None = None

    def folder(self, name: str, batch: int) -> str:
        return os.path.join(self.base, name, f"batch={batch:012d}")

    def steps(self, stream: DataFrame) -> DataFrame:
        """Rows of the stream and, beside them, the state before each run they touch."""
        kind = StructType([stream.schema[name] for name in STATE])
        run = stream.schema["run_id"].dataType.simpleString()
        narrow = stream.select(
            *[F.col(k).cast("string").alias(k) for k in ITEM],
            F.col("run_id").cast("long").alias("run_id"),
            F.col("id").cast("long").alias("id"),
            F.to_json(F.struct(*STATE)).alias("state"),
        )
        keys = ", ".join(f"k{i} string" for i in range(len(ITEM)))
        told = (
            narrow.mapInArrow(newest_in_batch, narrow.schema)
            .withColumn("share", F.pmod(F.xxhash64(*ITEM), F.lit(SHARES)))
            .groupBy("share")
            .applyInPandasWithState(
                run_history,
                outputStructType=f"{keys}, run_id long, previous string, again boolean",
                stateStructType=HISTORY,
                outputMode="update",
                timeoutConf=GroupStateTimeout.NoTimeout,
            )
        )
        row = F.struct(*stream.columns)
        return told.select(
            F.lit("run").alias("part"),
            *[F.col(f"k{i}").alias(name) for i, name in enumerate(ITEM)],
            F.col("run_id").cast(run).alias("run_id"),
            F.from_json("previous", kind).alias("previous"),
            "again",
            F.lit(None).cast(stream.schema).alias("row"),
        ).union(
            stream.select(
                F.lit("row").alias("part"), *ITEM, "run_id",
                F.lit(None).cast(kind).alias("previous"), F.lit(False).alias("again"), row.alias("row"),
            )
        )

    def process(self, step: DataFrame, batch: int) -> None:
        """Take one micro-batch of ``steps``."""
        spark = step.sparkSession
        # Written first: each read of a micro-batch would go through the state again.
        step.write.mode("overwrite").partitionBy("part").parquet(self.folder("steps", batch))
        taken = spark.read.schema(step.schema).parquet(self.folder("steps", batch))
        runs = taken.filter("part = 'run'").select(*ITEM, "run_id", "previous", "again")
        rows = taken.filter("part = 'row'").select("row.*")
        rows.write.mode("overwrite").partitionBy("run_id").parquet(self.folder("rows", batch))

        def compared(some: DataFrame, with_runs: DataFrame) -> DataFrame:
            return some.alias("a").join(with_runs.alias("b"), _same_item("a", "b")).select("a.*", "b.previous")

        mended = runs.filter("again")
        if mended.isEmpty():
            again = compared(rows, runs).limit(0)
        else:
            earlier = self._rows(spark, rows.schema).filter(F.col("batch") < batch).drop("batch")
            again = compared(earlier.select(*rows.columns), mended)
        both = compared(rows, runs).unionByName(again)
        changes.changes(both, self.profile).write.mode("overwrite").parquet(self.folder("changes", batch))
        again.select("id").write.mode("overwrite").parquet(self.folder("mended", batch))
        if self.log:
            # A run may go on in the next micro-batch, so each micro-batch owns its folder.
            stored = sinks.observation_rows(rows, F.current_timestamp().cast("timestamp_ntz"))
            stored.write.mode("overwrite").partitionBy("profile_slug", "run_id").parquet(
                os.path.join(self.log, f"batch={batch:012d}")
            )

    def _rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """Rows of all micro-batches; folders of runs that no one asks for are not read."""
        return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(
            os.path.join(self.base, "rows")
        )

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        spark = stream.sparkSession
        ship_package(spark)
        # State larger than memory stays on the executors' disks.
        spark.conf.set(STORE, ROCKS)
        return (
            self.steps(stream).writeStream.foreachBatch(self.process).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def read(self, spark: SparkSession) -> DataFrame:
        """The changes by the last comparison of each row."""
        found = spark.read.parquet(os.path.join(self.base, "changes"))
        void = spark.read.parquet(os.path.join(self.base, "mended"))
        newer = void.groupBy("id").agg(F.max("batch").alias("_since"))
        return (
            found.join(newer, "id", "left")
            .filter(F.col("_since").isNull() | (F.col("batch") >= F.col("_since")))
            .drop("_since", "batch")
        )


def observations(
    spark: SparkSession, folder: str, schema: StructType, files: int | None = None
) -> DataFrame:
    """Stream over the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)
