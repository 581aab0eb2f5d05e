"""Near copies by Golay keys: what is found, and that work grows with the rows."""

import numpy as np
import pytest

from folioflux.llm import near_copies


def family(copies, edits, seed, words=300):
    """Copies of one text that is not among them, each with so many words changed."""
    draw = np.random.default_rng(seed)
    base = [f"w{seed}x{n}" for n in draw.integers(0, 900, words)]
    texts = []
    for _ in range(copies):
        mine = list(base)
        for place in draw.choice(words, edits, replace=False):
            mine[place] = f"new{draw.integers(0, 10**9)}"
        texts.append(" ".join(mine))
    return texts


def plain_groups(texts):
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    group = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if group[i] != group[j] and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                group[group == group[i]] = group[j]
    return group


def found_groups(spark, texts, block=near_copies.BLOCK):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r["doc_id"]: r["root"] for r in near_copies.groups(docs, block).collect()}
    assert len(roots) == len(texts)
    return [roots[i] for i in range(len(texts))]


def test_share_of_pairs_found(spark):
    """Each pair alone, with similarities from just over 0.8 to 0.9."""
    draw = np.random.default_rng(11)
    texts = []
    for n in range(400):
        words = [f"p{n}q{i}" for i in range(200)]
        other = list(words)
        for place in draw.choice(200, int(draw.integers(2, 5)), replace=False):
            other[place] = f"edit{n}x{place}"
        texts += [" ".join(words), " ".join(other)]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    near = [n for n in range(400) if 5 * len(sets[2 * n] & sets[2 * n + 1]) >= 4 * len(sets[2 * n] | sets[2 * n + 1])]
    found = found_groups(spark, texts)
    both = sum(found[2 * n] == found[2 * n + 1] for n in near)
    assert len(near) > 250 and both >= 0.99 * len(near)
    others = set(range(400)) - set(near)
    assert not any(found[2 * n] == found[2 * n + 1] for n in others)
    assert len(set(found)) == 800 - both


def test_worked_out_recall():
    assert near_copies.recall_at(0.8) > 0.995 and near_copies.recall_at(0.85) > 0.999


@pytest.mark.parametrize("edits, block", [(3, 64), (4, 64), (4, 128), (8, 64)])
def test_large_family_in_small_blocks(spark, edits, block):
    """The keys of a family hold several blocks; the base that would join all is absent."""
    texts = family(400, edits, edits)
    wanted, found = plain_groups(texts), found_groups(spark, texts, block)
    # Only true links are made, and of the rows that go at least nine tenths go.
    joined = {}
    for w, f in zip(wanted, found):
        assert joined.setdefault(f, w) == w
    gone = len(texts) - len(set(wanted.tolist()))
    assert len(texts) - len(set(found)) >= 0.9 * gone
    assert edits > 4 or gone > 300


def test_pairs_grow_with_the_rows(spark, monkeypatch):
    """A family of twice the copies has about twice the compared pairs, at any similarity."""
    pairs = []
    verified = near_copies._verified

    def counted(found, sets):
        pairs.append(found.count())
        return verified(found, sets)

    monkeypatch.setattr(near_copies, "_verified", counted)
    for edits in (4, 8):
        counts = []
        for copies in (200, 400):
            pairs.clear()
            found_groups(spark, family(copies, edits, 5))
            counts.append(sum(pairs))
        # One pair a key and set at most; a set has six keys a segment. All pairs grow four-fold.
        assert counts[1] <= 3 * counts[0] and counts[1] <= 400 * 6 * near_copies.SEGMENTS


def test_forest_joins_what_all_similar_pairs_join():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 60, 50)
    sets = [np.unique(np.where(draw.random(50) < 0.06, draw.integers(0, 1 << 60, 50), base)) for _ in range(40)]
    roots = draw.integers(0, 25, 40)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    links = near_copies.similar_forest(roots, np.concatenate(sets), offsets)
    group, plain = roots.copy(), roots.copy()
    for i, j in links:
        group[group == group[i]] = group[j]
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                plain[plain == plain[i]] = plain[j]
    assert [len(set(group[plain == p].tolist())) for p in set(plain.tolist())] == [1] * len(set(plain.tolist()))
    assert len(set(group.tolist())) == len(set(plain.tolist()))


def test_long_texts_are_compared_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LONG", 250)
    texts = family(60, 4, 8) + family(20, 4, 9, words=120)
    wanted, found = plain_groups(texts), found_groups(spark, texts, 100)
    assert len(set(found)) == len(set(wanted.tolist()))


def test_odd_and_empty_tables(spark):
    texts = [None, "", " \t", "one two", "ONE  two", "wort " * 30000, "wort " * 40000]
    found = found_groups(spark, texts)
    assert found[0] == found[1] == found[2] and found[3] == found[4] and found[5] == found[6]
    assert len(set(found)) == 3
    empty = spark.createDataFrame([], "doc_id long, text string, node long")
    assert near_copies.groups(empty).collect() == []
