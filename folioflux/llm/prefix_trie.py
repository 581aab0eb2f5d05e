"""The trie of shared conversation prefixes, by hashing blocks of turns.

Blocks. The turns of a conversation are cut into blocks of ``BLOCK`` turns. A turn's digest
covers its place, role and text (two 64-bit hashes); digests are joined by exclusive or, so
the prefix up to the end of a block, and any prefix within it, has 128 bits that are summed
up like a count. Conversations are grouped by successive block digests first: one row for
each different (prefix before, prefix after) of a block, with its members' number, its
smallest member, and the turns of one of them.

Refinement. Where a prefix goes on with one block only, the block's turn boundaries are a
chain of nodes with the same members and nothing is compared. Where siblings diverge, and
only there, their turns are laid open and grouped by the prefix at each turn; what is laid
open is one row a different block, not one a conversation.

Subtrees. Every node belongs to its smallest member, its owner; an owner's nodes are the
deep end of its path. So sums over a subtree are sums over the node's members: leaves are
counted at their owners, and of the tokens shared, each member adds what its path still has
below the node, less the part of it that it owns. No walk over levels is needed.

Scale. Numbers inside a conversation come by ranges, running digests by chunks of
``CHUNK`` blocks with one carried row a chunk, and the ends of a node are hashed in runs of
``IDS`` that one task reads one after another without holding them. All other work is sums
that are made before they meet, and joins that can be split.

Defined cases: null roles and texts are empty; turns with one number follow in the order of
role and text, null numbers first; equal rows are turns of their own; rows without a
``conv_id`` belong to no conversation and are left out; a conversation without turns is a
member of the root alone; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.common import pick, shipped, slices, written
from folioflux.llm.sharding import CRC_TABLE_SQL
from folioflux.operators import ordered

BLOCK = 4
#: Blocks of one conversation whose running digests are made in one group.
CHUNK = 1024
#: Ids of one node that are joined into one text.
IDS = 1024
KEY = ("depth", "x1", "x2")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), d1, d2 (digest of role and text) and bytes of the text."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().cast("int").alias("numbered"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.where("conv_id is not null").select(
        "*",
        F.xxhash64("role", "text").alias("d1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("d2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    placed = ordered.position(rows, ["conv_id"], ["numbered", "turn", "role", "text"], "at")
    return placed.select("conv_id", (F.col("at") - 1).cast("long").alias("i"), "d1", "d2", "bytes")


def with_shared_starts(turns: DataFrame) -> DataFrame:
    """Conversations as the contract rebuilds them: the first turns of every fifth one.

    The first h turns of a conversation give way to those of conversation c - c % 5.
    """
    most = 8
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    started = (F.col("i") < most) & (F.pmod("conv_id", F.lit(5)) == 0)
    starts = turns.where(started).select(F.col("conv_id").alias("base"), "i", "d1", "d2", "bytes")
    starts = written(starts, "trie-starts")
    ids = turns.select("conv_id").distinct().withColumn("base", base).withColumn("head", head)
    lent = ids.join(starts, "base").where("i < head").select("conv_id", "i", "d1", "d2", "bytes")
    held = starts.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    own = turns.withColumn("base", base).withColumn("head", head).where("i >= head").join(held, "base", "left")
    taken = F.least("head", F.coalesce("held", F.lit(0).cast("long")))
    return lent.union(own.select("conv_id", F.col("i") - F.col("head") + taken, "d1", "d2", "bytes"))


def blocks_of(turns: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row a block: its turns, the prefix digests before (p) and after (q) it."""
    placed = turns.select(
        "conv_id",
        F.floor(F.col("i") / block).alias("k"),
        F.struct(
            (F.col("i") + 1).alias("depth"),
            F.xxhash64("i", "d1", "d2").alias("e1"),
            F.xxhash64(F.lit("second"), "i", "d2", "d1").alias("e2"),
            "bytes",
        ).alias("turn"),
    )
    blocks = placed.groupBy("conv_id", "k").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"),
        F.bit_xor("turn.e1").alias("b1"),
        F.bit_xor("turn.e2").alias("b2"),
        F.sum("turn.bytes").alias("block_bytes"),
    )
    blocks = written(blocks.withColumn("chunk", F.floor(F.col("k") / chunk)), "trie-blocks")
    sums = (F.bit_xor("b1"), F.bit_xor("b2"), F.sum("block_bytes"))
    names = ("1", "2", "bytes")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = blocks.groupBy("conv_id", "chunk").agg(
        F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("block_bytes").alias("block_bytes")
    )
    carried = chunks.select("conv_id", "chunk", *[s.over(earlier).alias(f"c{n}") for s, n in zip(sums, names)])
    carried = carried.where("chunk > 0")
    zero = F.lit(0).cast("long")
    running = blocks.select("*", *[s.over(inside).alias(f"r{n}") for s, n in zip(sums, names)]).join(
        carried, ["conv_id", "chunk"], "left"
    )

    def both(n: str) -> tuple[Column, Column]:
        return F.coalesce(f"r{n}", zero), F.coalesce(f"c{n}", zero)

    p1, p2 = (a.bitwiseXOR(b) for a, b in map(both, names[:2]))
    before = both("bytes")
    return written(
        running.select(
            "conv_id",
            "k",
            "turns",
            p1.alias("p1"),
            p2.alias("p2"),
            p1.bitwiseXOR(F.col("b1")).alias("q1"),
            p2.bitwiseXOR(F.col("b2")).alias("q2"),
            (before[0] + before[1]).alias("bytes_before"),
        ),
        "trie-running",
    )


def _opened(blocks: DataFrame, *carried: str) -> DataFrame:
    """One row a turn boundary of each block, with its prefix and the one before it."""

    def upto(n: Column) -> Column:
        start = F.struct(
            F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("bytes_before").alias("before")
        )
        return F.aggregate(
            F.slice("turns", 1, n),
            start,
            lambda a, t: F.struct(
                a.x1.bitwiseXOR(t.e1).alias("x1"),
                a.x2.bitwiseXOR(t.e2).alias("x2"),
                (a.before + t.bytes).alias("before"),
            ),
        )

    nodes = F.transform(
        "turns",
        lambda t, n: F.struct(t.depth.alias("depth"), t.bytes.alias("bytes"), upto(n).alias("from"), upto(n + 1).alias("to")),
    )
    return blocks.select(F.explode(nodes).alias("n"), *carried).select(
        F.col("n.depth").alias("depth"),
        F.col("n.to.x1").alias("x1"),
        F.col("n.to.x2").alias("x2"),
        F.col("n.from.x1").alias("up1"),
        F.col("n.from.x2").alias("up2"),
        F.col("n.bytes").alias("bytes"),
        F.col("n.from.before").alias("before"),
        *carried,
    )


def _at_turns(distinct: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Block sums at every turn boundary; only diverging blocks are grouped again."""
    carried = list(sums)
    chain = _opened(distinct.where("siblings = 1"), *carried)
    diverging = _opened(distinct.where("siblings > 1"), *carried)
    refined = diverging.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("up1", "up2", "bytes", "before")],
        *[column.alias(name) for name, column in sums.items()],
    )
    return chain.unionByName(refined)


def _joined_ends(ends: DataFrame, ids: int) -> DataFrame:
    """Per node the digest of its own conversations' ids, ascending and comma-joined."""
    shipped(ends.sparkSession)
    placed = ordered.position(ends, list(KEY), "conv_id", "at")
    runs = (
        placed.withColumn("run", F.floor((F.col("at") - 1) / ids))
        .groupBy(*KEY, "run")
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    )
    return (
        runs.repartition(*KEY)
        .sortWithinPartitions(*KEY, "run")
        .mapInArrow(_hash_runs, "depth long, x1 long, x2 long, ends_sha256 string")
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "ends_sha256"]
    types = [pa.int64()] * len(KEY) + [pa.string()]
    key, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for part in slices(pa.Table.from_batches([batch]).to_batches()):
            columns = [part[name].to_pylist() for name in (*KEY, "text")]
            for *mine, text in zip(*columns):
                if mine != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = mine, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((*key, digest.hexdigest()), types)], names=names
        )


def trie(
    turns: DataFrame, conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK, ids: int = IDS
) -> DataFrame:
    """All nodes of the trie over turns (conv_id, i, d1, d2, bytes) of conversations (conv_id)."""
    zero = F.lit(0).cast("long")
    blocks = blocks_of(turns, block, chunk)
    by_block = ("k", "p1", "p2", "q1", "q2")
    distinct = written(
        blocks.groupBy(*by_block).agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("owner"),
            F.first("turns").alias("turns"),
            F.first("bytes_before").alias("bytes_before"),
        ),
        "trie-distinct",
    )
    siblings = written(distinct.groupBy("k", "p1", "p2").agg(F.count(F.lit(1)).alias("siblings")), "trie-siblings")
    distinct = written(distinct.join(siblings, ["k", "p1", "p2"]), "trie-siblings")
    nodes = written(
        _at_turns(distinct, {"n_convs": F.sum("n_convs"), "owner": F.min("owner")}), "trie-nodes"
    )
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    children = written(children, "trie-children")
    nodes = nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = written(nodes, "trie-nodes")

    # What each conversation adds to the sums of the nodes it is a member of.
    lengths = blocks.groupBy("conv_id").agg(
        F.max_by(
            F.struct(F.get("turns", F.size("turns") - 1).getField("depth").alias("depth"), F.col("q1").alias("x1"), F.col("q2").alias("x2")),
            "k",
        ).alias("end"),
        F.sum(F.aggregate("turns", zero, lambda a, t: a + t.bytes)).alias("total"),
    )
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("from_depth"),
        F.min("before").alias("owned_before"),
        F.count_if(F.col("n_children") == 0).alias("leaves"),
    )
    members = (
        conversations.select("conv_id").distinct().join(lengths, "conv_id", "left").join(owned, "conv_id", "left")
    ).select(
        "conv_id",
        *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in KEY],
        F.coalesce("total", zero).alias("total"),
        F.coalesce(F.col("total") - F.col("owned_before"), zero).alias("owned"),
        F.coalesce("leaves", zero).alias("leaves"),
        "from_depth",
    )
    members = written(members, "trie-members")
    shares = ("total", "owned", "leaves")
    in_blocks = (
        blocks.select("conv_id", *by_block)
        .join(members.select("conv_id", *shares), "conv_id")
        .groupBy(*by_block)
        .agg(*[F.sum(s).alias(s) for s in shares])
    )
    in_blocks = written(distinct.drop("n_convs", "owner").join(in_blocks, list(by_block)), "trie-sums")
    sums = written(_at_turns(in_blocks, {s: F.sum(s) for s in shares}).select(*KEY, *shares), "trie-sums")
    ends = written(_joined_ends(members.select("conv_id", *KEY), ids), "trie-ends")

    # The root, where there is any conversation.
    top = children.where("depth = 0").select("n_children")
    root = members.agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), *[F.sum(s).alias(s) for s in shares]
    ).where("n_convs > 0")
    root = root.join(top, how="left").select(
        *[zero.alias(c) for c in (*KEY, "up1", "up2", "bytes", "before")],
        "n_convs",
        "owner",
        F.coalesce("n_children", zero).alias("n_children"),
        "total",
        "owned",
        F.greatest("leaves", F.lit(1).cast("long")).alias("leaves"),
    )
    every = nodes.join(sums, list(KEY)).unionByName(root)
    every = written(every, "trie-every")
    of_owner = members.select(
        F.col("conv_id").alias("owner"),
        F.col("total").alias("owner_total"),
        F.col("owned").alias("owner_owned"),
        F.col("from_depth"),
    )
    # Only the first node that an owner has lies under another owner's.
    told = every.join(of_owner, "owner")
    parents = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("owner").alias("above")
    ).where("n_children > 0")
    first = written(told.where("depth = from_depth").select("owner", "depth", "up1", "up2"), "trie-first")
    above = written(first.join(parents, ["depth", "up1", "up2"]).select("owner", "depth", "above"), "trie-above")
    saved = (
        F.col("total") - F.col("n_convs") * F.col("before")
        - (F.col("owned") - F.col("owner_owned") + F.col("owner_total") - F.col("before"))
    )
    return (
        told.join(above, ["owner", "depth"], "left")
        .join(ends, list(KEY), "left")
        .select(
            F.col("owner").alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The trie over the conversations with shared starts."""
    turns = written(turns_of(conversations), "trie-turns")
    rebuilt = written(with_shared_starts(turns), "trie-rebuilt")
    return trie(rebuilt, turns.select("conv_id"))


SQL = f"""
WITH t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS crc),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), t
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, p.n, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.base AND p.n <= i.h
  UNION ALL SELECT i.conv_id, 1, p.n, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.n > i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
    string_agg(md5(length(role) || ':' || role || text), ',') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY path, depth
), up AS (
  SELECT n.*, CASE WHEN depth > 1 THEN left(path, length(path) - 33) WHEN depth = 1 THEN '' END AS above FROM nodes n
), counted AS (
  SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u
  LEFT JOIN (SELECT above, count(*) AS n FROM up WHERE above IS NOT NULL GROUP BY above) k ON k.above = u.path
), below AS (
  SELECT DISTINCT a.path AS path, b.path AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT b.path, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum((c.n_convs - 1) * c.bytes) AS BIGINT) AS saved_tokens
  FROM below b JOIN counted c ON c.path = b.lower GROUP BY b.path
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS members
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.members, '')) AS ends_sha256
FROM counted c JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = c.above LEFT JOIN ends e ON e.path = c.path
"""
