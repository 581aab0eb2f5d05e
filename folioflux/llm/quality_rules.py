"""Quality rules with the document frequency of lines.

Base rules look at one text. The method's rule looks across documents: lines are
normalised (lower case, digits as 0, white space runs as one space) and hashed; for each
host, which is the ``source`` of a document, the distinct documents that hold a line are
counted. A line is limited to ``MOST_SHARE`` of its host's documents, and to ``LEAST_MANY``
documents where the host is small; so the same share of a host's lines goes whatever the
number of rows. A line above its limit is removed, and a document that keeps less than ``LEAST_SHARE`` of its words or
fewer than ``LEAST_WORDS`` words is depleted and rejected. Rows of one text on a host are
one document to the rule unless ``copies_count``, so that what was copied whole is left
to the deduplication operators.

Only hashes and counts of lines are shuffled, never texts: distinct (line, text) pairs
first, so a line with a third of all rows is summed up before it meets in one place; the
frequent lines are then joined back to the lines of the documents.

Defined cases: a null text counts as empty, a null source is a host of its own; an empty
text has no words and fails the base; rows with the same id and text are one document
with the same verdict; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import SPACES, fresh, pick, shipped, slices, text_or_empty, written

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
BASE_WORDS = 10
#: A line in more than this share of its host's documents, and in more documents than
#: that, is not the document's own.
MOST_SHARE, LEAST_MANY = 0.002, 20
LEAST_SHARE, LEAST_WORDS = 0.3, 5
DIGITS = str.maketrans("123456789", "000000000")


def repeated_window_words(words: list[bytes]) -> int:
    """Words in five-word windows that are found twice or more."""
    n = len(words)
    if n <= WINDOW_WORDS:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    code = ids
    # Exact codes of ever longer windows: the pair of (shorter window, next word), renumbered.
    for size in range(2, WINDOW_WORDS + 1):
        pairs = code[:-1] * len(known) + ids[size - 1 :]
        if size < WINDOW_WORDS:
            code = np.unique(pairs, return_inverse=True)[1].ravel()
    order = np.argsort(pairs, kind="stable")
    same = np.diff(pairs[order]) == 0
    repeated = np.zeros(len(pairs), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    starts = np.flatnonzero(repeated)
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits bytes at exactly the six white space characters
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def line_hash(line: str) -> int:
    """Signed 64-bit hash of the normalised line."""
    text = " ".join(line.lower().translate(DIGITS).split())
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (
    "doc_id long, source string, content long, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", lines array<struct<line: long, words: long>>"
)
LINES_TYPE = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, lines = [], []
        for text in batch["text"].to_pylist():
            counts.append(base_counts(text))
            words: dict[int, int] = {}
            for line in text.split("\n"):
                if n := len(line.encode("utf-8", "surrogatepass").split()):
                    key = line_hash(line)
                    words[key] = words.get(key, 0) + n
            lines.append([{"line": k, "words": n} for k, n in words.items()])
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["source"],
                batch["content"],
                *[pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))],
                pa.array(lines, LINES_TYPE),
            ],
            names=["doc_id", "source", "content", *COUNTS, "lines"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """Per row its source, a hash of its text, its counts, and its lines as hashes."""
    shipped(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", source="source", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.xxhash64(text_or_empty()).alias("content"),
        text_or_empty().alias("text"),
    )
    return written(rows.mapInArrow(_measure, MEASURED), "measured")


def frequent_in(
    rows: DataFrame, most_share: float, least_many: int, copies_count: bool = False
) -> DataFrame:
    """source, content, line, words: lines of each text above the limit of its host."""
    texts = rows.groupBy("source", "content").agg(F.count(F.lit(1)).alias("rows"))
    weight = F.col("rows") if copies_count else F.lit(1)
    limits = texts.groupBy("source").agg(
        F.greatest(F.lit(float(least_many)), most_share * F.sum(weight)).alias("most")
    )
    lines = rows.select("source", "content", F.explode("lines").alias("at")).select(
        "source", "content", "at.line", "at.words"
    )
    # One row per line and distinct text, then one per line.
    once = lines.groupBy("source", "line", "content").agg(
        F.max("words").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    counts = once.groupBy("source", "line").agg(F.sum(weight).alias("documents")).where(
        F.col("documents") > least_many
    )
    # One row a host; written, so that a host with most lines can be split.
    frequent = written(counts, "line-counts").join(written(limits, "host-limits"), "source")
    frequent = frequent.where("documents > most").select("source", "line")
    # Written, so that both sides of the join come from a shuffle of their own: only then
    # can a line with very many texts be split.
    return once.drop("rows").join(written(frequent, "frequent-lines"), ["source", "line"])


def apply_rules(
    docs: DataFrame,
    most_share: float = MOST_SHARE,
    least_many: int = LEAST_MANY,
    least_share: float = LEAST_SHARE,
    least_words: int = LEAST_WORDS,
    copies_count: bool = False,
) -> DataFrame:
    """Per row its counts, ``base_failed``, the words removed, and ``kept``."""
    rows = measured(docs)
    removed = (
        frequent_in(rows, most_share, least_many, copies_count)
        .groupBy("source", "content")
        .agg(F.sum("words").alias("removed_words"))
    )
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    base_failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    )
    depleted = (left < least_share * F.col("n_words")) | (left < least_words)
    return rows.drop("lines").join(removed, ["source", "content"], "left").select(
        "doc_id",
        *COUNTS,
        base_failed.alias("base_failed"),
        F.coalesce(F.col("removed_words"), F.lit(0)).alias("removed_words"),
        (~base_failed & ~depleted).alias("kept"),
    )


def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, hashes in zip(texts, gone):
        if text is not None and hashes is not None and len(hashes):
            found = set(map(int, hashes))
            lines = text.split("\n")
            text = "\n".join(x for x in lines if not x.strip(SPACES) or line_hash(x) not in found)
        out.append(text)
    return pd.Series(out, dtype=object)


def without_frequent_lines(
    docs: DataFrame, most_share: float = MOST_SHARE, least_many: int = LEAST_MANY
) -> DataFrame:
    """All rows and columns, the texts without the lines that too many texts of a host hold."""
    gone = frequent_in(measured(docs), most_share, least_many).groupBy("source", "content")
    host, content, lines = (fresh(docs, f"_rules_{n}") for n in ("host", "content", "lines"))
    keyed = docs.withColumns(
        {
            host: F.coalesce(docs["source"].cast("string"), F.lit("")),
            content: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))),
        }
    )
    found = gone.agg(F.collect_set("line").alias(lines)).select(
        F.col("source").alias(host), F.col("content").alias(content), lines
    )
    joined = keyed.join(found, [host, content], "left")
    without = F.pandas_udf(_without, "string")
    text = without(joined["text"].cast("string"), joined[lines])
    return joined.select(*[text.alias(c) if c.lower() == "text" else joined[c] for c in docs.columns])


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words
  FROM documents
), grams AS (
  SELECT doc_id, text, i, array_to_string(words[i:i + {WINDOW_WORDS - 1}], ' ') AS gram
  FROM (SELECT doc_id, text, words, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS i FROM d)
), repeated AS (
  SELECT doc_id, text, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, text, i, unnest(range({WINDOW_WORDS})) AS k FROM (
      SELECT DISTINCT doc_id, text, i, count(*) OVER (PARTITION BY doc_id, text, gram) AS times FROM grams)
    WHERE times > 1)
  GROUP BY doc_id, text
), lines AS (
  SELECT doc_id, source, text, line,
    len(list_filter(string_split_regex(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS n_words,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '\s+', ' ', 'g')) AS plain
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
), solid AS (
  SELECT * FROM lines WHERE n_words > 0
), copies AS (
  SELECT doc_id, text, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY doc_id, text
), hosts AS (
  SELECT source, greatest({LEAST_MANY}, {MOST_SHARE} * count(DISTINCT text)) AS most FROM d GROUP BY source
), frequent AS (
  SELECT source, plain FROM solid JOIN hosts USING (source) GROUP BY source, plain, most HAVING count(DISTINCT text) > most
), removed AS (
  SELECT doc_id, text, sum(n_words) AS n FROM solid JOIN frequent USING (source, plain) GROUP BY doc_id, text
), counts AS (
  SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(c.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS removed_words
  FROM d LEFT JOIN copies c ON c.doc_id = d.doc_id AND c.text = d.text
  LEFT JOIN repeated r ON r.doc_id = d.doc_id AND r.text = d.text
  LEFT JOIN removed m ON m.doc_id = d.doc_id AND m.text = d.text
)
SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < {BASE_WORDS} OR 100 * n_repeat_words > 20 * n_words)
  AND n_words - removed_words >= {LEAST_SHARE} * n_words AND n_words - removed_words >= {LEAST_WORDS} AS kept
FROM counts
"""
