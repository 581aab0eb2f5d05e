"""Documents into shards of nearly equal bytes, by minimax contiguous partition.

Order. A document's group is its text: equal texts are one atomic group and stay in one
shard. Groups are ordered by a key, the first ``KEY_BITS`` bits of the text's MD5 (texts
that share them by chance are one group too); a shard is a run of groups in that order, so
its documents are also well mixed.

Capacity. A binary search finds the smallest capacity with which the groups, in order, go
into the given number of shards; each capacity is checked greedily, a shard taking groups
as long as they fit. A group above the capacity takes a shard of its own: it bounds the
largest shard whatever is done, and must not widen all others. So the largest shard is as
small as any cut in this order can make it, and the shards besides such groups too. The
cuts are then those of the greedy walk at that capacity.

Scale. Sizes are summed per group before anything else; the walk needs their order only
near the cuts. The groups are summed into blocks of keys (a few ten thousand rows, whatever
the input). The capacity lies between two bounds: blocks taken as atoms, and blocks that
may be cut anywhere. Only the blocks in which a cut may fall between the bounds are summed
again by longer keys, until the bounds meet and each cut stands before a single group. Few
groups can hold more than a quarter of a shard's share; they are taken out first and
always stand alone, so the bounds hold for any skew.

Column functions alone: MD5, CRC-32, sums and windows; the driver gets block sums. Slots
number the documents of a shard in the order of the key and ``doc_id``, by ranges, so
a shard is never in one task.

Defined cases: a null text has no bytes and is equal to an empty one; rows without a
``doc_id`` come last in their group, repeated rows are rows of their own; shards may be
empty where there are fewer groups than shards; an empty table gives no row; other columns
are kept by ``assign`` and ``write_shards``, whatever they are called, and ignored by
``digest``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import fresh, pick, text_or_empty, written
from folioflux.operators import ordered

SHARDS = 40
#: Bytes a document takes besides its text.
OVERHEAD = 16
#: Fifteen hexadecimal digits.
KEY_BITS = 60
#: Blocks of keys whose sums the driver gets at once.
MOST_BLOCKS = 1 << 15


@dataclass(frozen=True)
class Block:
    """Groups with keys from ``first`` to ``last``; ``shift`` low bits were cut off."""

    first: int
    last: int
    size: int
    groups: int
    shift: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


@dataclass
class Walk:
    """The blocks' prefix sums, with greedy walks at any capacity."""

    blocks: Sequence[Block]
    shards: int
    before: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.before = [0, *accumulate(b.size for b in self.blocks)]

    def cuts(self, capacity: int, divisible: bool) -> tuple[list[int], bool]:
        """The block at or in which each shard ends; whether the shards hold everything.

        ``divisible``: blocks of several groups may be cut anywhere.
        """
        count, total = len(self.blocks), self.before[-1]
        # Groups above the capacity stand alone.
        alone = [i for i, b in enumerate(self.blocks) if b.atomic and b.size > capacity]
        at, ends, next_alone = 0, [], 0
        for _ in range(self.shards):
            if at >= total:
                break
            block = bisect_right(self.before, at) - 1
            while next_alone < len(alone) and alone[next_alone] < block:
                next_alone += 1
            wall = alone[next_alone] if next_alone < len(alone) else count
            if wall == block:
                at = self.before[block + 1]
            else:
                limit = min(at + capacity, self.before[wall])
                end = bisect_right(self.before, limit) - 1
                inside = divisible and end < count and not self.blocks[end].atomic
                at = limit if inside else self.before[end]
            ends.append(bisect_right(self.before, at) - 1)
        return ends, at >= total

    def smallest(self, least: int, divisible: bool) -> int:
        """The smallest capacity from ``least`` on that is enough."""
        low, high = least, max(least, self.before[-1])
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, divisible)[1]:
                high = middle
            else:
                low = middle + 1
        return low


@dataclass(frozen=True)
class Cuts:
    """The capacity, and the first key of each shard after the first."""

    capacity: int
    starts: tuple[int, ...]

    def shard(self, key: Column) -> Column:
        if not self.starts:
            return F.lit(0)
        starts = F.array(*[F.lit(s).cast("long") for s in self.starts])
        return F.size(F.filter(starts, lambda start: start <= key))


def group_key(text: Column) -> Column:
    digits = F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def size_of(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.octet_length(text) + overhead).cast("long")


def _large(groups: DataFrame, shards: int) -> tuple[list[Block], int, int]:
    """The groups above a quarter of a shard's share of what the others hold.

    Returns them, that bound, and how many others there are. Each round takes fewer than
    four a shard, and a further one is needed only where they held half of everything.
    """
    total, count = groups.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, above = total or 0, None
    found: list[Block] = []
    while total:
        least = total // (4 * shards)
        is_large = F.col("size") > least
        if above is not None:
            is_large &= F.col("size") <= above
        rows = groups.where(is_large).collect()
        found += [Block(r["key"], r["key"], r["size"], 1, 0) for r in rows]
        held = sum(r["size"] for r in rows)
        above = least
        if 2 * held <= total:
            break
        total -= held
    return sorted(found, key=lambda b: b.first), above or 0, count - len(found)


def _summed(groups: DataFrame, large: Sequence[Block], shift: int) -> list[Block]:
    """Blocks of the groups' keys without their low bits, parted at the large groups."""
    walls = F.array(*[F.lit(b.first).cast("long") for b in large]) if large else None
    part = F.size(F.filter(walls, lambda w: w < F.col("key"))) if large else F.lit(0)
    rows = (
        groups.groupBy(part.alias("part"), F.shiftright("key", shift).alias("block"))
        .agg(
            F.min("key").alias("first"),
            F.max("key").alias("last"),
            F.sum("size").alias("size"),
            F.count(F.lit(1)).alias("groups"),
        )
        .collect()
    )
    return [Block(r["first"], r["last"], r["size"], r["groups"], shift) for r in rows]


def _finer(blocks: Sequence[Block], most: int) -> int:
    """How many low bits to cut off next, so that few blocks arise; some block is split."""
    shift = max(b.shift for b in blocks) - 1
    while shift and sum(1 << max(0, b.shift - shift + 1) for b in blocks) <= most:
        shift -= 1
    return shift


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, most_blocks: int = MOST_BLOCKS) -> Cuts:
    """The smallest capacity for groups (key, size) and the greedy cuts at it."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    large, least, others = _large(groups, shards)
    rest = groups.where(F.col("size") <= least)
    bits = min(KEY_BITS, max(1, most_blocks.bit_length() - 1))
    blocks = [*large, *(_summed(rest, large, KEY_BITS - bits) if others else [])]
    while True:
        blocks.sort(key=lambda b: b.first)
        walk = Walk(blocks, shards)
        low = walk.smallest(least, divisible=True)
        high = walk.smallest(low, divisible=False)
        if low == high:
            ends, _ = walk.cuts(high, divisible=False)
            open_ = {e for e in ends if e < len(blocks) and not blocks[e].atomic}
            if not open_:
                starts = [blocks[e].first for e in ends if e < len(blocks)]
                return Cuts(high, tuple(starts))
        else:
            earliest, _ = walk.cuts(low, divisible=False)
            latest, _ = walk.cuts(high, divisible=True)
            # A walk that got stuck or ended early stays where it is.
            earliest += [earliest[-1] if earliest else 0] * (shards - len(earliest))
            latest += [len(blocks)] * (shards - len(latest))
            # The nearest bounds first: a cut that is settled often settles those after it.
            open_: set[int] = set()
            for a, b in sorted(zip(earliest, latest), key=lambda ends: ends[1] - ends[0]):
                more = {i for i in range(a, min(b, len(blocks) - 1) + 1) if not blocks[i].atomic}
                if open_ and len(open_ | more) > most_blocks // 8:
                    break
                open_ |= more
        shift = _finer([blocks[i] for i in open_], most_blocks)
        split = [i for i in sorted(open_) if blocks[i].shift > shift]
        runs = _runs(blocks, split)
        firsts, lasts = (
            F.array(*[F.lit(k).cast("long") for k in keys])
            for keys in zip(*((blocks[i].first, blocks[j].last) for i, j in runs))
        )
        # A key is in a run where more runs have begun than have ended before it.
        begun = F.size(F.filter(firsts, lambda k: k <= F.col("key")))
        wanted = begun > F.size(F.filter(lasts, lambda k: k < F.col("key")))
        finer = _summed(rest.where(wanted), large, shift)
        summed_again = {i for first, last in runs for i in range(first, last + 1)}
        alone = {b.first for b in large}
        blocks = [
            b for i, b in enumerate(blocks) if i not in summed_again or b.first in alone
        ] + finer


def _runs(blocks: Sequence[Block], split: Sequence[int]) -> list[tuple[int, int]]:
    """Runs of blocks from one to be split to another with only single groups between."""
    runs: list[list[int]] = []
    for i in split:
        if runs and all(b.atomic for b in blocks[runs[-1][1] + 1 : i]):
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, b) for a, b in runs]


def group_sizes(docs: DataFrame, text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    rows = docs.select(text_or_empty(text).alias("text"))
    sized = rows.select(group_key(F.col("text")).alias("key"), size_of(F.col("text"), overhead).alias("size"))
    return written(sized.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> tuple[DataFrame, str, str]:
    """All rows and columns with shard and slot, and the names of these two columns."""
    cuts = minimax_cuts(group_sizes(docs, overhead=overhead), shards)
    shard, slot, key = (fresh(docs, n) for n in ("shard", "slot", "_shard_key"))
    keyed = docs.withColumn(key, group_key(text_or_empty())).withColumn(shard, cuts.shard(F.col(key)))
    placed = ordered.position(keyed, [shard], [key, "doc_id"], slot)
    return placed.withColumn(slot, (F.col(slot) - 1).cast("long")).drop(key), shard, slot


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, rows_a_file: int = 1 << 20) -> str:
    """One folder a shard with its documents in the order of their slots.

    A shard is written by many tasks, each a range of slots; returns the shard column's name.
    """
    placed, shard, slot = assign(docs, shards)
    (
        placed.repartitionByRange(shard, slot)
        .sortWithinPartitions(shard, slot)
        .write.option("maxRecordsPerFile", rows_a_file)
        .partitionBy(shard)
        .parquet(folder)
    )
    return shard


def digest(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Per document its size, checksum, shard and slot, without carrying texts along."""
    text = F.col("text")
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    narrow = written(
        rows.select(
            "doc_id",
            group_key(text).alias("key"),
            size_of(text, overhead).alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        ),
        "shard-rows",
    )
    groups = written(narrow.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = minimax_cuts(groups, shards)
    sharded = narrow.withColumn("shard", cuts.shard(F.col("key")))
    placed = ordered.position(sharded, ["shard"], ["key", "doc_id", "text_crc32"], "slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 of the bytes written as hexadecimal digits in ``digits``; ``t.crc`` is its table.
CRC_TABLE_SQL = """(SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i)
  FROM (SELECT unnest(range(256)) AS i))"""


def crc_sql(digits: str) -> str:
    """SQL for the CRC-32 of bytes given as hexadecimal digits."""
    values = f"list_transform(regexp_extract_all({digits}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = "lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {values}), {step}))"


_NEXT_SQL = """CASE WHEN sizes[pos + 1] > c THEN pos + 1 ELSE pos + len(list_filter(range(pos + 1, n + 1),
      lambda k: upto[k + 1] <= upto[pos + 1] + c AND k < wall)) END"""
_WALL_SQL = "coalesce(list_min(list_filter(range(pos + 1, n + 1), lambda k: sizes[k] > c)), n + 1) AS wall"

SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS crc),
docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(text, '')), 1, {KEY_BITS // 4}) AS BIGINT) AS key,
    CAST(octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS BIGINT) AS size FROM documents
), sums AS MATERIALIZED (
  SELECT key, size, row_number() OVER (ORDER BY key) AS i, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto
  FROM (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY key)
), lists AS MATERIALIZED (
  SELECT list(size ORDER BY i) AS sizes, list_prepend(0, list(upto ORDER BY i)) AS upto, count(*) AS n,
    CAST(sum(size) AS BIGINT) AS total FROM sums
), search AS (
  -- One shard a step at capacity c; after the last one the bounds move.
  SELECT CAST(0 AS BIGINT) AS low, total AS high, total // 2 AS c, CAST(0 AS BIGINT) AS pos, 0 AS used FROM lists
  UNION ALL
  SELECT CASE WHEN tried AND pos < n THEN c + 1 ELSE low END, CASE WHEN tried AND pos >= n THEN c ELSE high END,
    CASE WHEN NOT tried THEN c WHEN pos >= n THEN (low + c) // 2 ELSE (c + 1 + high) // 2 END,
    CASE WHEN tried THEN 0 ELSE {_NEXT_SQL} END, CASE WHEN tried THEN 0 ELSE used + 1 END
  FROM (SELECT s.*, l.*, used >= {SHARDS} OR pos >= n AS tried, {_WALL_SQL} FROM search s, lists l WHERE low < high)
), walk AS (
  SELECT CAST(0 AS BIGINT) AS pos, 0 AS shard, max(low) AS c FROM search WHERE low = high
  UNION ALL
  SELECT {_NEXT_SQL}, shard + 1, c FROM (SELECT w.*, l.*, {_WALL_SQL} FROM walk w, lists l WHERE pos < n)
), sharded AS (
  SELECT s.key, max(w.shard) AS shard FROM sums s JOIN walk w ON w.pos < s.i GROUP BY s.key
), checked AS (
  SELECT text, {crc_sql('hex(encode(text))')} AS crc FROM (SELECT DISTINCT text FROM docs), t
)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS LAST, crc) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM docs JOIN sharded USING (key) JOIN checked USING (text)
"""
