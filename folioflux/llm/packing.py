"""Packing by minimum bin slack.

Documents longer than a window are cut at its multiples; only the remainders need
packing. Their lengths are counted (at most one count for each length below the window,
however many documents there are), and the driver plans on these counts alone: the
longest remaining length opens a window, and a subset-sum over a bitset finds the
multiset of remaining lengths that comes closest to filling it; walking the bitsets back
gives how many of each length it takes. The same pattern is repeated as long as the
counts last, so the plan's size does not depend on the number of documents.

The pieces then find their place without meeting in one task: a piece's rank among those
of its length is its rank in a random share of them plus the sizes of the shares before,
and the plan maps (length, rank) to a sequence and an offset.

Defined cases: a null text counts as empty and is one piece with only the end id;
repeated rows are packed each by itself; an empty table gives no row; other columns are
ignored. Pieces are written once before they are ranked, so every later step sees the
same rows when a task is repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.common import fan_out, pick, shipped, slices, text_or_empty, written
from folioflux.llm.encode import encoder

WINDOW = 2048

PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(tokenizer: str | None, end_id: int, window: int, keep_ids: bool):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows = {n: [] for n in ("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            texts = words.encode_all(batch["text"].to_pylist())
            for doc_id, found in zip(batch["doc_id"].to_pylist(), texts):
                data = found + end
                total = len(data) // 4
                for start in range(0, total, window):
                    piece = data[4 * start : 4 * (start + window)]
                    rows["piece"].append(number)
                    rows["doc_id"].append(doc_id)
                    rows["start"].append(start)
                    rows["length"].append(len(piece) // 4)
                    rows["ids_crc32"].append(zlib.crc32(piece))
                    rows["doc_tokens"].append(total)
                    rows["ids"].append(piece)
                    number += 1
            columns = {k: pa.array(v, pa.int64()) for k, v in rows.items() if k != "ids"}
            if keep_ids:
                columns["ids"] = pa.array(rows["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return cut


def pieces_of(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str | None = None,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """Every document's ids, cut at multiples of the window; ``ids`` holds them if asked."""
    shipped(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    return rows.mapInArrow(
        _cutter(tokenizer, end_id, window, keep_ids), PIECES + (", ids binary" if keep_ids else "")
    )


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to ``room`` without going over it.

    ``counts`` says how many of each length there are. A bit of ``reach`` is set where a
    sum can be had; each step adds a power-of-two number of copies of one length.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, how many of each length) that use up all counts."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        pattern = closest_fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, pattern))
    return plan


@dataclass(frozen=True)
class Places:
    """The plan by (length, first rank), sorted by both."""

    key: np.ndarray
    first_rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray


#: Ranks below this fit beside a length in one key.
RANKS = 1 << 48


def places(plan: list[tuple[int, dict[int, int]]]) -> Places:
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            first, each = seen.get(length, 0), pattern[length]
            rows.append((length * RANKS + first, first, sequence, each, offset))
            seen[length] = first + times * each
            offset += length * each
        sequence += times
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Places(*table.T.copy())


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give each of the written pieces its ``sequence_id`` and its ``offset`` there."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = places(plan_windows(counts, window))
    shares = fan_out(spark)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("piece"), F.lit(shares)))
    ranked = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("piece")) - 1
    )
    sizes = dealt.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(plan.key, n * RANKS + r, side="right") - 1
        past = r - plan.first_rank[at]
        return pd.DataFrame(
            {
                "sequence_id": plan.sequence[at] + past // plan.each[at],
                "offset": plan.offset[at] + past % plan.each[at] * n,
            }
        )

    found = ranked.join(bases, ["length", "share"]).withColumn(
        "place", place(F.col("length"), F.col("rank") + F.col("base"))
    )
    kept = [c for c in pieces.columns if c != "piece"]
    return found.select(*kept, "place.sequence_id", "place.offset")


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str | None = None,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """All documents as pieces of sequences of at most ``window`` ids."""
    pieces = written(pieces_of(docs, window, tokenizer, end_id, keep_ids), "pieces")
    return pack_pieces(pieces, window)
