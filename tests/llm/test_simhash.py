import re

import numpy as np
import pytest
import xxhash

from folioflux.llm import golay, simhash
from folioflux.llm.components import smallest_reachable


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """Smallest position reachable, by comparing all pairs."""
    group = list(range(len(prints)))
    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            if group[j] != group[i]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_golay_is_perfect():
    octets, errors = golay._tables()
    assert len(set(errors.tolist())) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    near = golay.nearby(words)
    assert {len(set(row)) for row in near.tolist()} <= {1, 6}
    for bit in range(23):
        other = golay.nearest(words ^ (1 << bit))
        assert (near == other[:, None]).any(axis=1).all()


def test_every_close_pair_has_a_key():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for place in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(place)

    def keys(prints):
        at_home, everywhere = [set() for _ in prints], [set() for _ in prints]
        for i, key, home in zip(*(x.tolist() for x in simhash.keys_of(prints))):
            everywhere[i].add(key)
            if home:
                at_home[i].add(key)
        return at_home, everywhere

    (home_a, _), (_, all_b) = keys(a), keys(b)
    assert all(x & y for x, y in zip(home_a, all_b))


def near_words(rng, count):
    """Prints in chains and clusters of few bits."""
    centres = rng.integers(0, 1 << 62, 6)
    out = []
    for _ in range(count):
        value = int(rng.choice(centres))
        for place in rng.choice(64, rng.integers(0, 5), replace=False):
            value ^= 1 << int(place)
        out.append(value)
    return sorted(set(out))


@pytest.mark.parametrize("crowd", [1000, 2])
def test_links_join_what_all_pairs_join(spark, crowd):
    prints = near_words(np.random.default_rng(crowd), 250)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    stars = smallest_reachable(simhash.links_of(frame, crowd), "test").collect()
    root = {r["u"]: r["v"] for r in stars}
    mine = [root.get(p, p) for p in signed]
    expected = groups_of(prints)
    assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog " * 3),
    (2, "the QUICK brown fox jumps over the lazy dog " * 3),
    (3, None),
    (4, " \t\n"),
    (5, "two words"),
    (6, "Two\x0bwords"),
    (7, "one"),
    (None, "one"),
    (9, "É é\xa0x y z"),
    (9, "a wholly other text of the same id"),
    (5, "two words"),
]


def docs_of(spark):
    rows = [(d, t, "x", 1) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, print string, component_id int")


def test_near_duplicates_of_odd_rows(spark):
    found = simhash.near_duplicates(docs_of(spark)).select("doc_id", "fingerprint", "component_id").collect()
    group = groups_of([plain_print(t) for _, t in TEXTS])
    least = {g: min((d for (d, _), h in zip(TEXTS, group) if h == g and d is not None), default=None) for g in group}
    expected = [(d, format(plain_print(t), "016x"), least[g]) for (d, t), g in zip(TEXTS, group)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert simhash.near_duplicates(docs_of(spark).where("false")).count() == 0


def test_one_of_each_keeps_one_row_a_group(spark):
    kept = simhash.one_of_each(docs_of(spark))
    assert kept.columns == docs_of(spark).columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(texts, key=str) == sorted(
        [(1, TEXTS[0][1]), (3, None), (5, "two words"), (7, "one"), (9, TEXTS[8][1]), (9, TEXTS[9][1])], key=str
    )


def test_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    stars = smallest_reachable(spark.createDataFrame(links, "u long, v long"), "test").collect()
    assert {(r["u"], r["v"]) for r in stars} == {(i, 0) for i in range(1, 61)} | {
        (i, 100) for i in range(101, 160)
    }


def edited_texts(rng):
    """Texts in families of copies with more and more words changed, and unlike ones."""
    texts = []
    for family in range(12):
        base = [f"w{family}x{n}" for n in rng.integers(0, 400, 40 + 15 * family)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for place in rng.choice(len(words), edits, replace=False):
                words[place] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    return texts + ["one two", "ONE  two", "one two three four five six", None, " "]


def plain_groups(texts):
    """Groups of five-word Jaccard similarity 0.8 and more, by comparing all pairs."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_one_of_each_joins_all_of_similarity_four_fifths(spark):
    texts = edited_texts(np.random.default_rng(3))
    expected = plain_groups(texts)
    by_bits = groups_of([plain_print(t) for t in texts])
    assert len(set(by_bits)) > len(set(expected))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(expected))
