"""Insert/delete similarity of titles and names as vectorised functions.

Spark's ``levenshtein`` also substitutes and is another measure. The ratio here is
200 * LCS / (len + len). The longest common subsequence runs bit-parallel on
Python integers, one step per character.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

SCORES = StructType([StructField("fuzzy", IntegerType()), StructField("strict", DoubleType())])


def _common(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common(a, b) / total


@lru_cache(maxsize=100_000)
def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=100_000)
def token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    only_left, only_right = left - shared, right - shared
    if shared and (not only_left or not only_right):
        return 100.0
    base = len(" ".join(sorted(shared)))
    gap = 1 if base else 0
    rest_left, rest_right = " ".join(sorted(only_left)), " ".join(sorted(only_right))
    len_left, len_right = base + gap + len(rest_left), base + gap + len(rest_right)
    distance = len(rest_left) + len(rest_right) - 2 * _common(rest_left, rest_right)
    best = 100.0 - 100.0 * distance / (len_left + len_right)
    if base:
        # The shared words against each side with its remaining words.
        best = max(best, 200.0 * base / (base + len_left), 200.0 * base / (base + len_right))
    return best


@F.pandas_udf(IntegerType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Lower of the set and the sort measure, so extra words cost something."""
    return pd.Series(
        [
            None if a is None or b is None else round(min(token_set(a, b), token_sort(a, b)))
            for a, b in zip(left, right)
        ],
        dtype="Int32",
    )


@F.pandas_udf(SCORES)
def name_scores(
    wanted_full: pd.Series, wanted_short: pd.Series, found_full: pd.Series, found_short: pd.Series
) -> pd.DataFrame:
    fuzzy, strict = [], []
    for wf, ws, ff, fs in zip(wanted_full, wanted_short, found_full, found_short):
        best, match = 0.0, 0.0
        for a, a_short in zip(wf, ws):
            for b, b_short in zip(ff, fs):
                by_set = token_set(a, b)
                best = max(best, by_set, token_set(a_short, b_short))
                match = max(match, 100.0 if a == b else min(by_set, token_sort(a, b)))
        fuzzy.append(round(best))
        strict.append(match)
    return pd.DataFrame({"fuzzy": pd.Series(fuzzy, dtype="int32"), "strict": strict})


def author_scores(wanted: Column, found: Column) -> Column:
    """struct(fuzzy, strict) of two arrays of normalised authors.

    ``fuzzy`` ranks (best set measure, initials optional); ``strict`` confirms
    (lower of both measures on the full form only).
    """
    from folioflux.functions.text import full_names, substantial_names

    return name_scores(
        full_names(wanted), substantial_names(wanted), full_names(found), substantial_names(found)
    )
