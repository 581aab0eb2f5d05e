"""Near-duplicates by SimHash, found through fuzzy hashing with the Golay code.

A fingerprint has 64 bits; two documents are linked when theirs differ in three bits or
fewer. Copies with the same fingerprint are brought together first; all that follows is
on different fingerprints.

Keys. The bits fall into segments A and B of 23 bits and C of 18. A 23-bit word is
decoded to its nearest codeword; the codewords nearest to it and to its one-bit
neighbours, one or six of them, are its nearby indices. If two words differ in one bit,
the index of each is among the nearby ones of the other. Let a, b, c be the errors in the
segments, a + b + c <= 3. By pigeonhole one of these holds, and gives the pair a key:

* a = 0: the bits of A;  b = 0: the bits of B;
* c = 0, a = 1 or b = 1: the bits of C with an index near A, or one near B;
* a = b = 1 and c <= 1: an index near A with an index near B.

Where indices are used, a fingerprint is at home under its own index and visits under
the nearby ones; a visitor is compared with those at home.

Verification. Keys with one fingerprint, or with no one at home, are dropped after a
count. Under the others the candidates are compared bit by bit; of the links found, a
spanning forest goes on, which joins what all of them join, so no group is spelt out in
pairs. A key with more than ``CROWD`` fingerprints is not gathered at all: its
fingerprints go through exact balls instead. Two fingerprints differ in three bits or
fewer if and only if some word lies within one bit of the first and two of the second;
for each word, all that reach it within two bits are linked with one that reaches it
within one. That is 2,081 small rows a fingerprint, however large the crowd is.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
rows with the same id are rows of their own; rows without an id are linked but give no
component its name unless none of its rows has one (then it is null); an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm import near_copies
from folioflux.llm.common import fan_out, fresh, pick, shipped, slices, text_or_empty, written
from folioflux.llm.components import smallest_reachable
from folioflux.llm.golay import nearby

BITS, SHINGLE, SEED = 64, 3, 42
#: Orders rows without an id after all others.
LAST = (1 << 63) - 1
MOST_ERRORS = 3
#: Shingles whose hashes are held at once.
HASHES_AT_ONCE = 1 << 16
#: Fingerprints whose keys are made at once.
KEYS_AT_ONCE = 2048
#: Fingerprints under one key that are compared with one another; more go through balls.
CROWD = 1000
A_BITS = B_BITS = 23
C_BITS = BITS - A_BITS - B_BITS


def fingerprint(text: str) -> int:
    """The 64 majority bits over the hashes of a text's three-word shingles."""
    # bytes.lower changes A-Z only; bytes.split splits at the six white space characters.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), HASHES_AT_ONCE):
        until = at + HASHES_AT_ONCE
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at:until], last[at:until])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(first)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed 64-bit number."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch["text"].to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["content"], pa.array(found.view("<i8"), pa.int64())],
                names=["doc_id", "content", "print"],
            )

    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("content"),
        text_or_empty().alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, content long, print long")


def segments(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = prints.astype(np.uint64)
    mask = np.uint64((1 << A_BITS) - 1)
    return (
        (words & mask).astype(np.int64),
        (words >> np.uint64(A_BITS) & mask).astype(np.int64),
        (words >> np.uint64(A_BITS + B_BITS)).astype(np.int64),
    )


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the prints (by position) has which key, and whether it is at home there."""
    a, b, c = segments(prints)
    near_a, near_b = nearby(a).astype(np.int64), nearby(b).astype(np.int64)
    near_a = np.concatenate([near_a[:, :1], _others(near_a)], axis=1)
    near_b = np.concatenate([near_b[:, :1], _others(near_b)], axis=1)
    count, width = near_a.shape
    at = np.arange(count)
    owner, key, home = [at, at], [a, 1 << 40 | b], [np.ones(count, bool)] * 2

    def add(kind: int, values: np.ndarray, valid: np.ndarray) -> None:
        rows, columns = np.nonzero(valid)
        owner.append(rows)
        key.append(kind << 40 | values[rows, columns])
        home.append(columns == 0)

    add(2, c[:, None] << 12 | near_a, near_a >= 0)
    add(3, c[:, None] << 12 | near_b, near_b >= 0)
    pairs = near_a[:, :, None] << 12 | near_b[:, None, :]
    valid = (near_a[:, :, None] >= 0) & (near_b[:, None, :] >= 0)
    add(4, pairs.reshape(count, width * width), valid.reshape(count, width * width))
    return np.concatenate(owner), np.concatenate(key), np.concatenate(home)


def _others(near: np.ndarray) -> np.ndarray:
    """The nearby indices that differ from the own one, each once; -1 where there is none."""
    rest = np.sort(near[:, 1:], axis=1)
    again = np.zeros_like(rest, dtype=bool)
    again[:, 1:] = rest[:, 1:] == rest[:, :-1]
    rest[again | (rest == near[:, :1])] = -1
    return -np.sort(-rest, axis=1)[:, :5]


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, KEYS_AT_ONCE):
        prints = batch["print"].to_numpy(zero_copy_only=False)
        owner, key, home = keys_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(prints[owner]), pa.array(home)], names=["key", "print", "home"]
        )


def forest(prints: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what all links between those at home and the others join."""
    group = np.arange(len(prints))
    links = []
    for i in np.flatnonzero(home):
        close = np.bitwise_count(prints ^ prints[i]) <= MOST_ERRORS
        for j in np.flatnonzero(close & (group != group[i])):
            if group[j] != group[i]:
                links.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        u, v = [], []
        sets, offsets = batch["found"], batch["found"].offsets.to_numpy()
        members = sets.values
        prints = members.field("print").to_numpy(zero_copy_only=False)
        home = members.field("home").to_numpy(zero_copy_only=False)
        for start, end in zip(offsets[:-1], offsets[1:]):
            mine = prints[start:end]
            for i, j in forest(mine.view(np.uint64), home[start:end]):
                u.append(int(mine[i]))
                v.append(int(mine[j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _ball(bits: int) -> np.ndarray:
    """All words of at most so many ones."""
    words = [sum(1 << p for p in places) for n in range(bits + 1) for places in combinations(range(BITS), n)]
    return np.array(words, dtype=np.uint64)


def _around(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(bits)
        for batch in slices(batches, 64):
            prints = batch["print"].to_numpy(zero_copy_only=False).view(np.uint64)
            words = (prints[:, None] ^ ball).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array(np.repeat(prints.view(np.int64), len(ball)))],
                names=["word", "print"],
            )

    return run


def ball_links(prints: DataFrame) -> DataFrame:
    """Links that join all of these prints that differ in three bits or fewer."""
    hubs = (
        prints.mapInArrow(_around(1), "word long, print long")
        .groupBy("word")
        .agg(F.min("print").alias("hub"))
    )
    reached = prints.mapInArrow(_around(2), "word long, print long")
    return reached.join(hubs, "word").where("print <> hub").select(
        F.col("print").alias("u"), F.col("hub").alias("v")
    ).distinct()


def links_of(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between different prints that join all that differ in few bits."""
    keyed = distinct.mapInArrow(_emit_keys, "key long, print long, home boolean")
    counted = written(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("prints"), F.count_if("home").alias("at_home"))
        .where("prints > 1 and at_home > 0")
        .select("key", "prints"),
        "simhash-keys",
    )
    gathered = (
        keyed.join(counted.where(F.col("prints") <= crowd), "key", "left_semi")
        .groupBy("key")
        .agg(F.collect_list(F.struct("print", "home")).alias("found"))
        .select("found")
    )
    links = gathered.mapInArrow(_verify, "u long, v long").distinct()
    crowded = counted.where(F.col("prints") > crowd)
    if crowded.isEmpty():
        return links
    in_crowds = written(
        keyed.join(crowded, "key", "left_semi").select("print").distinct(), "simhash-crowds"
    )
    return links.union(ball_links(in_crowds))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    ``content`` is a hash of the text and ``root`` a name that each component has alone.
    """
    marked = written(fingerprints(docs), "simhash")
    # One row per different print, with the smallest id that has it.
    distinct = written(marked.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "simhash-prints")
    # Prints are small and make many keys each: dealt out, each task holds few of them.
    prints = distinct.select("print").repartition(fan_out(docs.sparkSession))
    stars = smallest_reachable(links_of(prints, crowd), "simhash")
    members = stars.select(F.col("u").alias("print"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("print"), F.col("v").alias("root")).distinct()
    )
    named = (
        members.join(distinct, "print")
        .groupBy("root")
        .agg(F.min("doc_id").alias("component_id"))
        .join(members, "root")
        .select("print", "component_id", "root")
    )
    linked = F.col("root").isNotNull()
    # Written, so that both sides of the last join come from a shuffle of their own and
    # a print with very many documents can be split.
    labels = distinct.join(named, "print", "left").select(
        "print",
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("root", "print").alias("root"),
    )
    labels = written(labels, "simhash-labels")
    return marked.join(labels, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "content",
        "root",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with all its columns.

    Groups are those of ``near_copies``: five words and a similarity of 0.8, not three bits. Rows without an id are represented by others where there are any.
    """
    doc, content, rank = (fresh(docs, f"_simhash_{n}") for n in ("doc", "content", "rank"))
    keyed = docs.withColumns(
        {
            doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)),
            content: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))),
        }
    )
    found = near_copies.groups(keyed.select(F.col(doc).alias("doc_id"), docs["text"]))
    stay = (
        found.groupBy("root")
        .agg(F.min(F.struct("doc_id", "content")).alias("stays"))
        .select(F.col("stays.doc_id").alias(doc), F.col("stays.content").alias(content))
    )
    # Equal rows: one, which is taken in each partition before the shuffle.
    first = F.row_number().over(Window.partitionBy(doc, content).orderBy(doc))
    once = keyed.withColumn(rank, first).where(F.col(rank) == 1)
    return once.join(stay, [doc, content], "left_semi").select(*docs.columns)
