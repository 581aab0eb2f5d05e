"""Line deduplication by windows of three lines.

Each three consecutive lines with text make a window, known by the 128-bit hash of its
trimmed lines. The first occurrence of a window, by document id and place, stays; every
later one covers its lines, and blank lines between them, and what the covering windows
together cover is removed. As a removed line always lies in an earlier occurrence of the
same window, the earliest copy of each line stays.

Windows are shuffled as hashes. The first occurrence of each is a minimum, summed up
before the shuffle; windows found once drop out there, and the join back is on the hash,
so a window with very many occurrences can be split. Only then do the spans meet the
texts.

Defined cases: a null text counts as empty and stays null; texts with fewer than three
lines with text have no window and stay; rows with the same id and text count as one
document and are treated alike; rows with the same id and other texts come in the order
of their hash; rows without an id come last; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import SPACES, fresh, shipped, slices, written

LINES = 3
#: Orders rows without an id after all others.
LAST = (1 << 63) - 1


def windows_of(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Both halves of each window's hash, and its first and last line."""
    solid = [(i, line) for i, raw in enumerate(text.split("\n")) if (line := raw.strip(SPACES))]
    for k in range(len(solid) - LINES + 1):
        these = solid[k : k + LINES]
        joined = "\n".join([line for _, line in these]).encode("utf-8", "surrogatepass")
        value = xxhash.xxh3_128_intdigest(joined)
        yield (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63), these[0][0], these[-1][0]


WINDOWS = "high long, low long, doc long, content long, first long, last long"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        rows = [
            (high, low, doc, content, first, last)
            for doc, content, text in zip(*(batch[c].to_pylist() for c in ("doc", "content", "text")))
            for high, low, first, last in windows_of(text)
        ]
        columns = list(zip(*rows)) if rows else [[]] * 6
        names = [part.split()[0] for part in WINDOWS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def _content(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def covered(docs: DataFrame) -> DataFrame:
    """doc, content, spans: lines (first, last) that later occurrences cover."""
    shipped(docs.sparkSession)
    keyed = docs.select(
        _doc(docs).alias("doc"),
        _content(docs).alias("content"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    windows = written(keyed.mapInArrow(_emit, WINDOWS), "line-windows")
    place = F.struct("doc", "content", "first")
    firsts = (
        windows.groupBy("high", "low")
        .agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
        .where("earliest <> latest")
        .select("high", "low", "earliest")
    )
    # Written, so that both sides of the join come from a shuffle of their own: only then
    # can a window with very many occurrences be split.
    firsts = written(firsts, "line-firsts")
    later = windows.join(firsts, ["high", "low"]).where(place != F.col("earliest"))
    return later.groupBy("doc", "content").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out, counts = [], []
    for text, found in zip(texts, spans):
        if text is None or found is None or len(found) == 0:
            out.append(text)
            counts.append(0)
            continue
        lines, until, kept = text.split("\n"), 0, []
        for span in sorted((s["first"], s["last"]) for s in found):
            kept += lines[until : span[0]]
            until = max(until, span[1] + 1)
        kept += lines[until:]
        out.append("\n".join(kept))
        counts.append(len(lines) - len(kept))
    return pd.DataFrame({"text": out, "lines_removed": counts})


def remove_repeated(docs: DataFrame, removed: str = "lines_removed") -> DataFrame:
    """All rows and columns with the shortened text, and how many lines went."""
    spans = covered(docs)
    doc, content, found = (fresh(docs, f"_line_{n}") for n in ("doc", "content", "found"))
    keyed = docs.withColumns({doc: _doc(docs), content: _content(docs)})
    joined = keyed.join(
        spans.select(F.col("doc").alias(doc), F.col("content").alias(content), F.col("spans").alias(found)),
        [doc, content],
        "left",
    )
    without = F.pandas_udf(_without, "text string, lines_removed long")
    changed = joined.withColumn(found, without(joined["text"].cast("string"), joined[found]))
    kept = [
        changed[found]["text"].alias("text") if c.lower() == "text" else changed[c] for c in docs.columns
    ]
    return changed.select(*kept, changed[found]["lines_removed"].alias(fresh(docs, removed)))


SQL = r"""
WITH rows AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM rows
), solid AS (
  SELECT doc_id, text, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, text, pos AS first, lead(pos, 2) OVER w AS last,
    line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS lines3
  FROM solid WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lines3 ORDER BY doc_id, first) AS n
  FROM windows WHERE last IS NOT NULL
), gone AS (
  SELECT DISTINCT r.doc_id, r.text, l.pos
  FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.text = r.text AND l.pos BETWEEN r.first AND r.last
  WHERE r.n > 1
), kept AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) AS left_text, count(*) AS n
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND g.pos = l.pos
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, coalesce(k.left_text, '') AS text,
  len(string_split(coalesce(d.text, ''), chr(10))) - coalesce(k.n, 0) AS lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.text = coalesce(d.text, '')
"""
