"""Repairs against every possible repair, in one piece and in many."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from folioflux.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(found, most_inserted=2):
    """(cost, initials) of all repairs of signs with few insertions in one place."""
    results = []

    def go(i, roles, cost, audit, inserted):
        if i == len(found) and re.fullmatch("(s?(ua)+)?", roles):
            results.append((cost, audit))
        if inserted < most_inserted:
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I", inserted + 1)
        if i < len(found):
            sign = found[i]
            more = 3 if sign.isupper() else 0
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if sign != "x":
                go(i + 1, roles + sign.lower(), cost + more, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return results


def by_table(found):
    """The least (cost, initials) by the cheapest rest from each place and role."""

    @cache
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(found) and state in "^a" else []
        due = {"^": "u", "s": "u", "u": "a", "a": "u"}[state]

        def step(initial, cost, j, after, n):
            if (way := rest(j, after, n)) is not None:
                ways.append((cost + way[0], initial + way[1]))

        if inserted < 2:
            step("I", 3, i, due, inserted + 1)
        if i < len(found):
            step("D", 4, i + 1, state, 0)
            more = 3 if found[i].isupper() else 0
            if found[i] != "x":
                if found[i].lower() == due or (found[i].lower() == "s" and state == "^"):
                    step("K", more, i + 1, found[i].lower(), 0)
                step("R", 3 + more, i + 1, due, 0)
        return min(ways, default=None)

    sys.setrecursionlimit(10_000)
    return rest(0, "^", 0)


def test_search_equals_every_repair():
    draw = random.Random(5)
    for _ in range(120):
        found = "".join(draw.choice("suaoxSUAO") for _ in range(draw.randint(0, 4)))
        wanted = min(every_repair(found))
        assert repair.search(found, repair.START, repair.GOOD_ENDS) == wanted == by_table(found), found


def test_search_equals_a_table_on_longer_rows():
    draw = random.Random(6)
    for weights in ((1, 8, 8, 1, 1, 0, 1, 1, 0), (1, 1, 1, 1, 1, 1, 1, 1, 1), (0, 9, 0, 0, 1, 0, 1, 0, 0)):
        for _ in range(60):
            found = "".join(draw.choices("suaoxSUAO", weights, k=draw.randint(5, 24)))
            assert repair.search(found, repair.START, repair.GOOD_ENDS) == by_table(found), found


def test_bounds_hold_and_prune():
    draw = random.Random(7)
    for _ in range(200):
        found = "".join(draw.choice("suaoxSUAO") for _ in range(draw.randint(1, 10)))
        bounds = repair.suffix_bounds(found)
        for i in range(len(found)):
            cheapest = min(
                way[0]
                for state in repair.STATES
                for end in repair.AFTER[state]
                if (way := repair.search(found[i:], state, (end,))) is not None
            )
            assert bounds[i] <= cheapest
    assert repair.suffix_bounds("uuaa")[0] == 6


@pytest.mark.parametrize("length, join", [(1, 2), (3, 2), (5, 4)])
def test_pieces_give_the_same_as_one(spark, length, join):
    draw = random.Random(length)
    found = ["".join(draw.choices("suaoxSUAO", (1, 8, 8, 1, 2, 1, 2, 2, 1), k=draw.randint(1, 40))) for _ in range(12)]
    found += ["x" * 9, "s" * 7, "ua" * 20, "S"]
    rows = [(c if c else None, i, s) for c, signs in enumerate(found) for i, s in enumerate(signs)]
    marked = spark.createDataFrame(rows, "conv_id long, at long, sign string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.audits(marked, length, join).collect()}
    assert got == {c if c else None: by_table(signs) for c, signs in enumerate(found)}


def plain(rows):
    """The whole digest, conversation by conversation."""
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        conversations[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = set()
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            cut = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(
                "blank" if not cut else "duplicate" if (role, text) in seen
                else "truncated" if cut[-1] not in ".!?" else None
            )
            seen.add((role, text))
        signs = ""
        for (_, role, _), fault in zip(turns, faults):
            sign = role[:1] if role[:1] and role[:1] in "sua" else "o"
            signs += "x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        cost, audit = by_table(signs)
        lines, state, i = [], "^", 0
        for edit in audit:
            due = {"^": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[due]
            if edit == "I":
                lines.append(name + ":")
                state = due
                continue
            _, role, text = turns[i]
            i += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else name}:{text}")
                state = role[0] if edit == "K" else due
        numbers = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        result.add((
            conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return result


def random_rows(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, 9)):
            rows.append((
                conv if conv else None,
                turn * draw.choice([1, 1, 1, 2]) if draw.random() < 0.95 else None,
                draw.choice(["user", "assistant", "system", "tool", "", None]),
                draw.choice(["Ja.", "Nein?", "straße", " \t", "", None, "Ende! \n", "x" * 3000 + "."]),
            ))
    return rows + rows[:5]


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_digest_equals_plain_python(spark):
    rows = random_rows(3)
    # A long conversation, and one whose only row is dropped.
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(500, t, ("user", "assistant")[t % 2 if t % 7 else 0], f"Satz {t}.") for t in range(150)]
    rows += [(dropped, 0, "user", "x")]
    table = spark.createDataFrame([(*r, 0, "y") for r in rows], SCHEMA + ", audit int, `at` string")
    got = repair.digest(table).select(*COLUMNS).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert set(map(tuple, got)) == plain(rows)
    alone = [tuple(r) for r in got if r["conv_id"] == dropped]
    assert alone == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_good_conversations(spark):
    table = spark.createDataFrame(random_rows(4), SCHEMA)
    turns = repair.repaired_turns(table).orderBy("conv_id", "place").collect()
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r["conv_id"], []).append(r["role"])
    assert by_conv and all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in roles)) for roles in by_conv.values())


def test_empty_table(spark):
    assert repair.digest(spark.createDataFrame([], SCHEMA)).collect() == []
