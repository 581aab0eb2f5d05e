"""The trie against one built turn by turn, at several block lengths and chunk sizes."""

import hashlib
import random
import zlib

import pytest

from folioflux.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Conversations by the contract's rule, from plain rows."""
    own = {}
    order = sorted(
        (r for r in rows if r[0] is not None),
        key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()),
    )
    for conv, _, role, text in order:
        own.setdefault(conv, []).append((role or "", text or ""))
    found = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        found[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return found


def plain_trie(conversations):
    nodes = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    rows = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        ends = sorted(c for c in members if len(conversations[c]) == len(path))
        rows.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(1 for q in nodes if q and q[:-1] == path), len(childless),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return rows


def found(frame):
    rows = frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def random_rows(seed, convs=40, length=11):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, length)):
            text = draw.choice(["ja", "nein", "straße", "", None])
            rows.append((conv * 3 % 50, turn if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]), text))
    return rows


@pytest.mark.parametrize("seed, block, chunk, ids", [(1, 4, 1024, 1024), (2, 2, 1, 2), (3, 1, 2, 1), (4, 7, 1, 3)])
def test_trie_equals_brute_force(spark, seed, block, chunk, ids):
    rows = random_rows(seed)
    table = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.turns_of(table)
    shared = prefix_trie.with_shared_starts(turns)
    got = prefix_trie.trie(shared, turns.select("conv_id"), block, chunk, ids)
    assert found(got) == plain_trie(rebuilt(rows))


def test_only_diverging_blocks_are_opened(spark):
    # Two conversations share six turns and differ in the eighth: blocks one has one sibling.
    rows = [(c, t, "user", f"t{t}" if t < 7 else f"t{t}-{c}") for c in (5, 10) for t in range(10)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    blocks = prefix_trie.blocks_of(turns, 4)
    distinct = blocks.select("k", "p1", "p2", "q1", "q2").distinct().groupBy("k", "p1", "p2").count().collect()
    assert sorted((r["k"], r["count"]) for r in distinct) == [(0, 1), (1, 2), (2, 1), (2, 1)]


def test_copies_long_and_turnless_conversations(spark):
    # 5 lends its turns to 6..9; a long one; a hundred copies; nulls; no conversation.
    rows = [(5, None, None, None), (None, 1, "user", "lost")]
    rows += [(7, t, "user", f"long {t % 3}") for t in range(120)]
    rows += [(c * 5, t, "user", "same") for c in range(20, 120) for t in range(3)]
    rows += [(c, 0, "user", "x") for c in (6, 8, 9, 11, 12, 13)] * 2
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.digest(table)) == plain_trie(rebuilt(rows))


def test_clashing_columns_and_empty_table(spark):
    rows = random_rows(9, convs=8)
    wide = spark.createDataFrame(
        [(*r, 1, 2, "x") for r in rows], SCHEMA + ", depth int, owner int, `_part` string"
    )
    assert found(prefix_trie.digest(wide)) == plain_trie(rebuilt(rows))
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).collect() == []
