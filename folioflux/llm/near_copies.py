"""Near copies by the overlap of five-word shingles, for a stage that keeps one of each.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of
0.8 or more. Texts with equal sets are brought together first; all that follows is on
different sets.

Fingerprints. A set has ``SEGMENTS`` segments of 23 bits, each bit drawn from a minimum
hash of the set, so a bit of two sets of similarity s differs with probability
(1 - s) / 2. By pigeonhole some segment of a similar pair has few errors.

Keys. Each segment is decoded to its nearest Golay codeword, and so are its one-bit
neighbours: a set is at home under its own index and visits under up to five nearby ones,
as for the 64-bit fingerprints. An index alone is shared by a share of all sets, so a key is
the index together with one minimum hash of another segment (its anchor), which unrelated
texts do not share. At similarity 0.8 a pair shares a segment's key with probability
0.8 * 0.596 (0.596: visits at an error rate of a tenth, ``recall_at``), and misses all ten with
probability 0.0015; at 0.85 with 0.0001.

Verification is exact, on whole sets, and pairs are never spelt out within a group. First
every set is compared with one hub under each of its keys: the set that shares most keys
with others, which is the most central one of a family of copies. That is one pair a key
and set at most, however large a key is. Keys whose sets are then of one component are
done. A key of the others is one block of sets, or, where it has more than ``BLOCK`` sets or
``WEIGHT`` shingles, its sets are put in order of further minimum hashes and cut into such
blocks. Every two blocks of a key that are not of one component are compared, all with all,
by one matrix product; only the links that join components leave it. So memory is bounded by
two blocks and no pair that shares a key is missed. A set is sent once for each key and each
block it is compared with: in proportion to the sets while a key is one block, and beyond
that by the square of a key's blocks where its sets are of many components.

Texts. Only sets that share a key are made, a part of all. A bitmap of fixed size says which
texts may be wanted, so the others are not shuffled; an exact join follows.

Defined cases: words are those of the fingerprints (A-Z in lower case, six white space
characters); a text of fewer than five words is one shingle, null and empty texts are
equal to one another and to nothing else; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.common import ROWS_A_BATCH, ROWS_AT_ONCE, fan_out, pick, shipped, slices, text_or_empty, written
from folioflux.llm.components import smallest_reachable
from folioflux.llm.golay import LENGTH, nearby
from folioflux.operators import ordered

SHINGLE, SEED = 5, 42
#: Similarity of linked sets, as a fraction.
LEAST, OF = 4, 5
SEGMENTS = 10
#: Sets of a key that are held at once, twice, and their shingles.
BLOCK, WEIGHT = 1024, 1 << 17
#: Pairs of blocks that are handed to a worker at once.
PAIRS_AT_ONCE = 8
#: Sets with more shingles are compared by a join, not gathered.
LONG = 1 << 14
#: Shingles whose minimum hashes are taken at once, and columns of a product.
HASHES_AT_ONCE, CELLS_AT_ONCE = 1 << 11, 1 << 22
#: Bits of the map of wanted texts, and of one of its words.
MAP_BITS, WORD_BITS = 1 << 24, 63
#: Minimum hashes that order the sets of a large key.
ORDER = 6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, SEGMENTS * LENGTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first)))


def minima(found: np.ndarray) -> np.ndarray:
    """One minimum hash a bit of a set that is not empty, by segments."""
    words = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(SEGMENTS * LENGTH, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(words), HASHES_AT_ONCE):
        np.minimum(least, (words[at : at + HASHES_AT_ONCE, None] * _FACTORS).min(axis=0), out=least)
    return least.reshape(SEGMENTS, LENGTH)


def segments(least: np.ndarray) -> np.ndarray:
    """The 23-bit words: a mixed bit of each minimum."""
    bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return (bits.astype(np.uint32) << np.arange(LENGTH, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def keys_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the segment of each, and whether the set is at home there."""
    near = nearby(segments(least)).astype(np.uint64)
    near = np.concatenate([near[:, :1], np.sort(near, axis=1)], axis=1)
    again = np.zeros(near.shape, dtype=bool)
    again[:, 2:] = near[:, 2:] == near[:, 1:-1]
    again[:, 1:] |= near[:, 1:] == near[:, :1]
    segment, column = np.nonzero(~again)
    anchors = np.roll(least[:, 0], -1).astype(np.uint64)
    keys = (anchors[segment] << np.uint64(16) | near[segment, column]) * _MIX ^ segment.astype(np.uint64)
    keys = (keys ^ keys >> np.uint64(31)) * _MIX
    return keys ^ keys >> np.uint64(29), segment, column == 0


def recall_at(similarity: float, trials: int = 20_000) -> float:
    """How often two sets of this similarity share a key, by drawing errors."""
    draw = np.random.default_rng(SEED)
    words = draw.integers(0, 1 << LENGTH, trials)
    errors = draw.random((trials, LENGTH)) < (1 - similarity) / 2
    others = words ^ (errors @ (1 << np.arange(LENGTH)))
    near, there = nearby(words), nearby(others)
    shared = (near == there[:, :1]).any(axis=1) | (there == near[:, :1]).any(axis=1)
    return 1 - (1 - similarity * shared.mean()) ** SEGMENTS


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


KEY = "array<struct<key: long, segment: long, home: boolean>>"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("key", pa.int64()), ("segment", pa.int64()), ("home", pa.bool_())]))
    for batch in slices(batches):
        nodes, sizes, counts, parts, orders = [], [], [0], [], []
        for text in batch["text"].to_pylist():
            found = shingles(text)
            nodes.append(_signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)))
            sizes.append(len(found))
            if len(found):
                least = minima(found)
                parts.append(keys_of(least))
                orders.append(least[:, 1].view(np.int32))
            else:
                orders.append([0] * SEGMENTS)
            counts.append(counts[-1] + (len(parts[-1][0]) if len(found) else 0))
        columns = [np.concatenate(c) for c in zip(*parts)] or [np.empty(0, t) for t in (np.uint64, np.int64, bool)]
        keys = pa.StructArray.from_arrays(
            [pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2])], fields=list(kind.value_type)
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["content"],
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), keys).cast(kind),
                pa.array(orders, pa.list_(pa.int32())),
            ],
            names=["doc_id", "content", "node", "size", "keys", "marks"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shingles(t).view(np.int64) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["node"], pa.array(found, pa.list_(pa.int64()))], names=["node", "found"]
        )


def _maybe_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose content is wanted, and a few others; the driver sees a bitmap only."""
    slot = F.pmod("content", F.lit(MAP_BITS))
    words = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / WORD_BITS).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % WORD_BITS).cast("int"))).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(MAP_BITS // WORD_BITS + 1, dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch["content"].to_numpy() % MAP_BITS
            yield batch.filter(pa.array((shared.value[slots // WORD_BITS] >> slots % WORD_BITS & 1).astype(bool)))

    return texts.mapInArrow(run, "content long, text string")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets are similar."""
    one = sets.select(F.col("node").alias("u"), F.col("found").alias("of_u"))
    other = sets.select(F.col("node").alias("v"), F.col("found").alias("of_v"))
    both = F.size(F.array_intersect("of_u", "of_v"))
    similar = (LEAST + OF) * both >= LEAST * (F.size("of_u") + F.size("of_v"))
    return pairs.join(one, "u").join(other, "v").where(similar).select("u", "v")


def _may_be(a: str, b: str):
    """Sets of these sizes can be similar."""
    return f"{OF} * least({a}, {b}) >= {LEAST} * greatest({a}, {b})"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4):
        u, v = [], []
        for members in part["members"]:
            found = members.values
            nodes, roots = (found.field(n).to_numpy() for n in ("node", "root"))
            sets = found.field("found")
            for i, j in similar_forest(roots, sets.values.to_numpy(), sets.offsets.to_numpy()):
                u.append(int(nodes[i]))
                v.append(int(nodes[j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def similar_forest(roots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what all similar pairs of these sets of different roots join."""
    sizes = np.diff(offsets)
    values = values[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # A shingle of one set alone is in no intersection.
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], (np.cumsum(times > 1) - 1)[column[times[column] > 1]]
    both = np.zeros((len(sizes), len(sizes)), dtype=np.float32)
    width = max(1, CELLS_AT_ONCE // max(1, len(sizes)))
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        here = (column >= at) & (column < at + width)
        one = np.zeros((len(sizes), min(width, int(column.max()) + 1 - at)), dtype=np.float32)
        one[owner[here], column[here] - at] = 1
        both += one @ one.T
    similar = (LEAST + OF) * both >= LEAST * (sizes[:, None] + sizes)
    group = np.unique(roots, return_inverse=True)[1]
    links = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1) & (group[:, None] != group))):
        if group[i] != group[j]:
            links.append((int(i), int(j)))
            group[group == group[j]] = group[i]
    return links


def _mixed(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of keys whose sets are not yet of one component, with the root of each."""
    roots = smallest_reachable(links, "copies-stars").select(F.col("u").alias("node"), F.col("v").alias("root"))
    labelled = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = written(labelled, "copies-labelled")
    mixed = labelled.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    return written(labelled.join(written(mixed, "copies-mixed"), "key", "left_semi"), "copies-rest")


def _within_blocks(rest: DataFrame, marks: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between sets of different components that share a key: each block of it against each."""
    names = [f"m{i}" for i in range(ORDER)]
    fit = F.floor(F.lit(WEIGHT) / F.greatest(F.max(F.least("size", F.lit(LONG))), F.lit(1)))
    large = (
        rest.groupBy("key")
        .agg(F.count(F.lit(1)).alias("sets"), F.least(F.lit(block), fit).alias("most"))
        .where("sets > most")
        .select("key", "most")
    )
    large = written(large, "copies-large")
    # The order under a key of one segment is by the marks of the others.
    turned = [F.get("marks", (F.col("segment") + 2 + i) % SEGMENTS).alias(n) for i, n in enumerate(names)]
    crowded = rest.join(large, "key").join(marks, "node").select("key", "node", "root", "size", "most", *turned)
    ranked = ordered.position(crowded, ["key"], [*names, "node"], "at")
    ranked = ranked.select("key", F.floor((F.col("at") - 1) / F.col("most")).alias("block"), "node", "root", "size")
    alone = rest.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("block"), "node", "root", "size")
    placed = written(alone.union(ranked), "copies-placed")
    # Two blocks of one component have nothing left to compare.
    spans = written(placed.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "copies-spans")
    two = (
        spans.alias("a").join(spans.alias("b"), "key")
        .where("a.block <= b.block and least(a.low, b.low) < greatest(a.high, b.high)")
        .select("key", F.col("a.block").alias("one"), F.col("b.block").alias("other"))
    )
    dealt = two.select("key", "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))
    blocks = written(placed.join(dealt, ["key", "block"]).drop("block"), "copies-blocks")
    # A set is fetched once, for all the blocks it is compared in.
    short = (
        blocks.where(F.col("size") <= LONG)
        .groupBy("node")
        .agg(F.first("root").alias("root"), F.collect_list(F.struct("key", "one", "other")).alias("places"))
        .join(sets, "node")
        .select("node", "root", "found", F.inline("places"))
        .groupBy("key", "one", "other")
        .agg(F.collect_list(F.struct("node", "root", "found")).alias("members"))
        .select("members")
        .mapInArrow(_forest, "u long, v long")
    )
    # A row holds two whole blocks, so a batch of the usual number of rows has no bound.
    spark = rest.sparkSession
    spark.conf.set(ROWS_A_BATCH, PAIRS_AT_ONCE)
    try:
        short = written(short, "copies-short")
    finally:
        spark.conf.set(ROWS_A_BATCH, ROWS_AT_ONCE)
    at_least = LONG * LEAST // OF
    long = blocks.where(F.col("size") > at_least)
    pairs = (
        long.alias("a")
        .join(long.alias("b"), ["key", "one", "other"])
        .where("a.node < b.node and a.root <> b.root")
        .where(f"greatest(a.size, b.size) > {LONG}")
        .where(_may_be("a.size", "b.size"))
        .select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        .distinct()
    )
    return short.union(_verified(pairs, sets.where(F.size("found") > at_least))).distinct()


def links_of(distinct: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that join the different sets that are similar.

    ``distinct`` has node, content, size, keys and marks, ``texts`` content and text.
    """
    keyed = distinct.select("node", "size", F.inline("keys"))
    shared = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("sets"), F.count_if("home").alias("homes"))
        .where("sets > 1 and homes > 0")
        .select("key", "sets")
    )
    keyed = written(keyed.drop("home").join(written(shared, "copies-shared"), "key"), "copies-keys")
    # How many other sets it shares keys with: the most central of a family shares most.
    reach = written(keyed.groupBy("node").agg(F.sum("sets").alias("reach")), "copies-reach")
    wanted = written(
        reach.select("node").join(distinct.select("node", "content", "marks"), "node"), "copies-wanted"
    )
    sets = (
        _maybe_wanted(texts, wanted).join(wanted.select("content"), "content", "left_semi")
        .groupBy("content")
        .agg(F.first("text").alias("text"))
        .join(wanted.select("node", "content"), "content")
        .select("node", "text")
        .mapInArrow(_sets, "node long, found array<long>")
    )
    sets = written(sets, "copies-sets")
    # A set has few keys, so a window over them is small.
    hubs = (
        keyed.withColumn("reach", F.sum("sets").over(Window.partitionBy("node")))
        .groupBy("key")
        .agg(F.max_by(F.struct("node", "size"), F.struct("reach", "node")).alias("hub"))
    )
    stars = (
        keyed.join(written(hubs, "copies-hubs"), "key")
        .where("node <> hub.node")
        .where(_may_be("size", "hub.size"))
        .select(F.col("node").alias("u"), F.col("hub.node").alias("v"))
        .distinct()
    )
    links = written(_verified(stars, sets), "copies-stars")
    rest = _mixed(keyed.drop("sets"), links)
    return links.union(_within_blocks(rest, wanted.select("node", "marks"), sets, block))


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, content (a hash of the text) and root, a name that each group has alone."""
    shipped(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("content"),
        text_or_empty().alias("text"),
    )
    marked = written(
        rows.mapInArrow(_mark, f"doc_id long, content long, node long, size long, keys {KEY}, marks array<int>"), "copies"
    )
    distinct = written(
        marked.groupBy("node").agg(
            F.min("content").alias("content"), *[F.first(c).alias(c) for c in ("size", "keys", "marks")]
        ),
        "copies-distinct",
    )
    dealt = distinct.repartition(fan_out(docs.sparkSession))
    stars = smallest_reachable(links_of(dealt, rows.select("content", "text"), block), "copies")
    # Written, so that both sides of the last join come from a shuffle of their own and
    # a set with very many documents can be split.
    labels = written(
        distinct.select("node")
        .join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
        .select("node", F.coalesce("root", "node").alias("root")),
        "copies-labels",
    )
    return marked.select("doc_id", "content", "node").join(labels, "node").select("doc_id", "content", "root")
