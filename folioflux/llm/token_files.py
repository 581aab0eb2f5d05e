"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A range shuffle puts the documents in ascending order of their id; each partition
writes one set of files:

``part-N.ids``  all ids of its documents one after the other, ``uint16`` or ``uint32``
``part-N.off``  ``int64``: where each document starts in it, and the end
``part-N.doc``  ``int64``: the documents' ids; ``-2**63`` stands for null

A part's base, the number of ids before its first one, is the prefix sum of the parts'
lengths, one number a file; a document's global offset is the base plus its own.

Files are written under a name of the attempt and then renamed, so a repeated or
speculative task leaves one whole file with the same content.

Defined cases: a null text counts as empty and has only the end id; rows with the same
id all stay, in the order of their text; null ids come first; an empty table gives no
file and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import pick, shipped, slices, text_or_empty
from folioflux.llm.encode import encoder

#: Stands for a null document id in the files.
NO_ID = -(2**63)
#: Documents that the reader hands on at once.
READ_DOCS = 4096


@dataclass(frozen=True)
class Part:
    """One set of files: its path without ending, its size and the ids before it."""

    path: str
    docs: int
    tokens: int
    base: int


def _commit(system: fs.FileSystem, temporary: str, path: str) -> None:
    try:
        system.move(temporary, path)
    except OSError:
        # Stores that do not replace: the file there is the same one of another attempt.
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(temporary)


def _writer(folder: str, tokenizer: str | None, end_id: int, width: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, most = encoder(tokenizer), np.iinfo(width).max
        if not 0 <= end_id <= most:
            raise ValueError(f"the end id {end_id} does not fit into {width}")
        end = np.asarray([end_id], dtype=width).tobytes()
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{task.partitionId():06d}"
        mark = f".try-{task.taskAttemptId()}"
        offsets, ids, total, out = array("q", [0]), array("q"), 0, None
        for batch in slices(batches):
            if out is None:
                out = system.open_output_stream(f"{path}.ids{mark}")
            data = words.encode_all(batch["text"].to_pylist())
            for doc_id, found in zip(batch["doc_id"].to_pylist(), data):
                tokens = np.frombuffer(found, dtype="<u4")
                # A narrower type would wrap around and store another token.
                if len(tokens) and tokens.max() > most:
                    raise ValueError(f"token id {tokens.max()} does not fit into {width}")
                out.write(tokens.astype(width).tobytes())
                out.write(end)
                total += len(tokens) + 1
                offsets.append(total)
                ids.append(NO_ID if doc_id is None else doc_id)
        if out is None:
            return
        out.close()
        for ending, numbers in (("off", offsets), ("doc", ids)):
            with system.open_output_stream(f"{path}.{ending}{mark}") as file:
                file.write(np.asarray(numbers, dtype="<i8").tobytes())
        for ending in ("ids", "off", "doc"):
            _commit(system, f"{path}.{ending}{mark}", f"{path}.{ending}")
        yield pa.RecordBatch.from_pydict(
            {"part": [task.partitionId()], "path": [path], "docs": [len(ids)], "tokens": [total]}
        )

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    width: str = "<u2",
) -> list[Part]:
    """Write all documents; the parts in order with their bases.

    ``folder`` must be one that all executors reach. ``width`` is the type of the ids in
    the files; ``<u2`` holds vocabularies below 65,536, and an id that does not fit is an
    error. The driver gets one row a file.
    """
    shipped(docs.sparkSession)
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    # The text's hash lets many rows of one id fall into several partitions.
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    found = ordered.mapInArrow(
        _writer(folder, tokenizer, end_id, width), "part long, path string, docs long, tokens long"
    ).collect()
    found.sort(key=lambda r: r["part"])
    bases = accumulate((r["tokens"] for r in found), initial=0)
    return [Part(r["path"], r["docs"], r["tokens"], base) for r, base in zip(found, bases)]


def _whole(system: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, else read."""
    if system.get_file_info(path).size == 0:
        return np.empty(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=dtype)


def _reader(folder: str, width: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                ids = _whole(system, f"{path}.ids", width)
                offsets = _whole(system, f"{path}.off", "<i8")
                doc_ids = _whole(system, f"{path}.doc", "<i8")
                for first in range(0, len(doc_ids), READ_DOCS):
                    these = np.asarray(doc_ids[first : first + READ_DOCS])
                    at = np.asarray(offsets[first : first + len(these) + 1])
                    checks = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(these, pa.int64(), mask=these == NO_ID),
                            pa.array(base + at[:-1], pa.int64()),
                            pa.array(np.diff(at), pa.int64()),
                            pa.array(checks, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, parts: list[Part], folder: str, width: str = "<u2") -> DataFrame:
    """What the files hold: per document its place, its length and the crc32 of its ids."""
    shipped(spark)
    if not parts:
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.createDataFrame([(p.path, p.base) for p in parts], "path string, base long")
    return files.repartition(len(parts)).mapInArrow(_reader(folder, width), READ_SCHEMA)
