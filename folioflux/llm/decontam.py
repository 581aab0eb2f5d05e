"""Benchmark passages in documents, found by pieces and verified by edit distance.

Texts are compared in lower case with one space for each run of white space. A test item
of n characters may differ in ``floor(ERROR_SHARE * n)`` edits. It is split into one
piece more than that; whatever the edits are, one piece is left whole, so every hit holds
an exact piece at about its place. All pieces are looked for at once by an automaton.
Around each piece found, the item's distance to the best-fitting stretch of the text is
computed with Myers' bit vectors, one machine step a character whatever the item's length
in words of the machine.

Items are queries: they are taken in blocks of at most ``BLOCK_CHARS`` characters, which
bounds what goes to the tasks, and each block is looked for in all documents. So any
number of items can be searched, and documents never move.

Pieces are at least ``LEAST_PIECE`` characters, so short items may differ in fewer edits;
items shorter than ``LEAST_ITEM`` characters are matched exactly and at word borders.

Defined cases: null, empty and blank items match nothing; a null text counts as empty and
holds nothing; items with the same id are looked for one by one and the best distance
counts; rows without an id are reported without one; an item is reported once a row;
other columns are ignored or, where rows are filtered, kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import fresh, pick, shipped

ERROR_SHARE = 0.08
LEAST_PIECE, LEAST_ITEM = 12, 24
BLOCK_CHARS = 2_000_000

Item = tuple[int | None, str]


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int) -> int:
    """How many edits an item of this length may differ in."""
    if length < LEAST_ITEM:
        return 0
    return max(0, min(int(ERROR_SHARE * length), length // LEAST_PIECE - 1))


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """The text in ``errors + 1`` pieces of about the same length, each with its place."""
    count = errors + 1
    borders = [i * len(text) // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(borders, borders[1:])]


def masks(pattern: str) -> dict[str, int]:
    """Where each character stands in the pattern."""
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def best_distance(found: dict[str, int], length: int, text: str) -> int:
    """Least edit distance of the pattern to any stretch of the text (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, length
    for c in text:
        equal = found.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus = plus << 1 & full
        up = (minus << 1 & full) | (full & ~(vertical | plus))
        down = plus & vertical
    return best


class Finder:
    """Looks for all items of one block in a text."""

    def __init__(self, items: list[Item]):
        self._items, self._automaton = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            errors = budget(len(text))
            self._items.append((item_id, text, errors, masks(text)))
            for place, piece in pieces(text, errors):
                at[piece].append((len(self._items) - 1, place))
        for piece, uses in at.items():
            self._automaton.add_word(piece, (len(piece), uses))
        self._automaton.make_automaton()

    def find(self, text: str) -> dict[int | None, int]:
        """The items in the text, each with its least distance."""
        if not self._items:
            return {}
        text = plain(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, uses) in self._automaton.iter(text):
            for number, place in uses:
                starts[number].add(end + 1 - length - place)
        best: dict[int | None, int] = {}
        for number, places in starts.items():
            item_id, pattern, errors, found = self._items[number]
            for low, high in _stretches(sorted(places), len(pattern), errors):
                distance = self._distance(text, low, high, pattern, errors, found)
                if distance <= errors and distance < best.get(item_id, distance + 1):
                    best[item_id] = distance
        return best

    @staticmethod
    def _distance(text: str, low: int, high: int, pattern: str, errors: int, found: dict[str, int]) -> int:
        if len(pattern) < LEAST_ITEM:
            around = text[max(0, low - 1) : high + 1]
            at = around.find(pattern)
            before, after = around[:at][-1:], around[at + len(pattern) :][:1]
            return 1 if at < 0 or before.isalnum() or after.isalnum() else 0
        stretch = text[max(0, low) : high]
        return 0 if pattern in stretch else best_distance(found, len(pattern), stretch)


def _stretches(starts: list[int], length: int, errors: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text around the places where an item may start."""
    first = last = starts[0]
    for start in starts[1:]:
        if start - last > 2 * errors:
            yield first - errors, last + length + errors
            first = start
        last = start
    yield first - errors, last + length + errors


def blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items with text, plain, in blocks of bounded size."""
    rows = pick(items, item_id="item_id", text="text").where("text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def _hits(block: list[Item]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(block)
        for texts in batches:
            yield pd.Series(
                [[{"item_id": i, "distance": d} for i, d in finder.find(t).items()] for t in texts]
            )

    return F.pandas_udf(run, "array<struct<item_id: long, distance: int>>")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def hits(docs: DataFrame, items: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance of every item in every document."""
    shipped(docs.sparkSession)
    found = None
    for block in blocks(items, chars):
        part = docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), F.explode(_hits(block)(_text(docs))).alias("hit")
        ).select("doc_id", "hit.item_id", "hit.distance")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    return found


def only_clean(docs: DataFrame, items: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    shipped(docs.sparkSession)
    found, columns = fresh(docs, "_items_found"), docs.columns
    for block in blocks(items, chars):
        # A column of its own keeps the search from running once for each use.
        docs = docs.withColumn(found, F.size(_hits(block)(_text(docs))))
        docs = docs.where(docs[found] == 0).select(*[docs[c] for c in columns])
    return docs
