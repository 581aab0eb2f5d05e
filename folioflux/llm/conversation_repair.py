"""Conversation structure repaired at the least cost, by depth-first branch and bound.

A good conversation has roles ``(s?(ua)+)?``: one system turn at most, first, then user and
assistant in turn. Each row may be kept (cost 0), given the role that is due (3), or
deleted (4; the only way for blank and repeated rows), and an empty turn of the due role
may be inserted anywhere (3). A truncated row that is not deleted adds 3. Since the role
that is due is always known, the initials of the edits (``D I K R``) in order tell the
whole repair; of repairs of one cost the ASCII-least initials win.

Search. A row is one sign: what its role begins with and which fault it has. Over the signs
a search with an explicit stack goes depth-first and in ASCII order through (place, last
role) nodes. What a suffix costs at least, whatever came before, is the sum of each row's
cheapest edit plus what neighbours of one role cost beyond that, over pairs that do not
overlap. A prefix is dropped if its cost and that bound exceed the incumbent, or if its node
was reached before at no greater cost: as prefixes come in ASCII order, the table of each
node only needs its least cost so far. The first incumbent comes from a greedy dive. When
the stack is empty, the incumbent is proved best.

Long conversations. The signs are cut into pieces of ``PIECE`` rows. For each piece but a
lone one, the search runs once for each role it may follow and end with; a prefix that is
part of another of the same cost and node does not occur, so the least (cost, initials) of
joined pieces are made of the least of the pieces. Pieces are joined in groups of ``JOIN``,
level by level, so no group grows with the conversation.

Texts are not gathered. Rows get numbers by ranges, repeated rows are found by minima, and
the digest of a repaired conversation, which is sequential, is made by reading its rows in
order in one task, one batch at a time, after a row with its edits.

Defined cases: null roles and texts are one space, null ids and numbers are one space in
the damage's key; rows with one number follow in the order of role and text (as damaged);
an empty role begins with nothing and can only be changed or deleted; rows without
``conv_id`` are one conversation; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import SPACES, pick, shipped, slices, written
from folioflux.llm.sharding import CRC_TABLE_SQL
from folioflux.operators import ordered

#: Characters that are not blank, and those that end a whole text; fixed by the contract.
BLANK, STOPS = SPACES, ".!?"
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that are searched at once, and results of pieces joined at once.
PIECE, JOIN = 64, 64
#: What came last: nothing, a system, a user or an assistant turn.
START, SYSTEM, USER, ASSISTANT = "^", "s", "u", "a"
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that is due after each; a system turn may also be kept at the start.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
GOOD_ENDS = (START, ASSISTANT)
#: What can come last after each, with any edits between.
AFTER = {START: STATES, SYSTEM: STATES[1:], USER: STATES[2:], ASSISTANT: STATES[2:]}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage: dropped, emptied, cut, repeated or retyped."""
    space = F.lit(" ")
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind = F.crc32(key.cast("binary")) % 20
    hurt = rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", f"[{STOPS}]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hurt.drop("copy")


def signs(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their number ``at``, fault and sign.

    The sign is the role's initial, ``o`` for any but s, u and a; in upper case where the
    row is truncated; ``x`` where it must go.
    """
    placed = ordered.position(
        rows.withColumns(
            {
                "numbered": F.col("turn").isNotNull().cast("int"),
                # Equal role and text; 256 bits, so different ones do not meet.
                "same": F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256),
            }
        ),
        ["conv_id"],
        ["numbered", "turn", "role", "text"],
        "at",
    )
    placed = written(placed.withColumn("at", (F.col("at") - 1).cast("long")), "repair-placed")
    repeated = (
        placed.groupBy("conv_id", "same")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("of"), F.col("same").alias("same_"), "first")
    )
    # Written, so that a conversation that is repeated all over can be split.
    repeated = written(repeated, "repair-repeated")
    on = placed["conv_id"].eqNullSafe(repeated["of"]) & (placed["same"] == repeated["same_"])
    trimmed = F.rtrim("text", F.lit(BLANK))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("at") > F.col("first"), "duplicate")
        .when(~F.right(trimmed, F.lit(1)).isin(*STOPS), "truncated")
    )
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin(SYSTEM, USER, ASSISTANT), initial).otherwise("o")
    sign = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper(kept))
        .otherwise(kept)
    )
    return (
        placed.join(repeated, on, "left")
        .withColumn("fault", fault)
        .select("conv_id", "turn", "at", "role", "text", "fault", sign.alias("sign"))
    )


def cheapest(sign: str) -> int:
    """What a row costs at least."""
    if sign == "x":
        return DELETE
    kept = 0 if sign in "suaSUA" else RETYPE
    return min(DELETE, kept + TRUNCATED) if sign.isupper() else kept


def suffix_bounds(found: str) -> list[int]:
    """What the rows from each place on cost at least, whatever came before them.

    Two neighbours of one role, with rows between that must go at most, cost more than
    their own least: a turn between them, another role for one, or one of them.
    """
    count = len(found)
    least, bounds, later = [0] * (count + 1), [0] * (count + 1), [count] * (count + 1)
    for i in range(count - 1, -1, -1):
        later[i] = i if found[i] != "x" else later[i + 1]
        least[i] = cheapest(found[i]) + least[i + 1]
        bounds[i] = cheapest(found[i]) + bounds[i + 1]
        j = later[i + 1]
        if j < count and found[i] in "uaUA" and found[j].lower() == found[i].lower():
            more = min(RETYPE, INSERT, DELETE - cheapest(found[i]), DELETE - cheapest(found[j]))
            bounds[i] = max(bounds[i], least[i] - least[j + 1] + more + bounds[j + 1])
    return bounds


def edits(state: str, sign: str | None) -> list[tuple[str, str, int, int]]:
    """(initial, next state, cost, rows used) of each edit, in ASCII order."""
    due = DUE[state]
    found = []
    if sign is not None:
        found.append(("D", state, DELETE, 1))
    found.append(("I", due, INSERT, 0))
    if sign is not None and sign != "x":
        more = TRUNCATED if sign.isupper() else 0
        role = sign.lower()
        if role == due:
            found.append(("K", due, more, 1))
        elif role == SYSTEM and state == START:
            found.append(("K", SYSTEM, more, 1))
        found.append(("R", due, RETYPE + more, 1))
    return found


def _dive(found: str, start: str, ends: tuple[str, ...], bounds: list[int]) -> tuple[int, str]:
    """A good repair: at each place the edit of the least cost and bound."""
    at, state, cost, audit = 0, start, 0, ""
    while at < len(found):
        choices = edits(state, found[at])
        # An insertion is worth it only where the row can then be kept.
        choices = [
            c for c in choices if c[3] or any(n[0] == "K" for n in edits(c[1], found[at]))
        ]
        initial, state_, more, used = min(choices, key=lambda c: (c[2] + bounds[at + c[3]], c[0]))
        at, state, cost, audit = at + used, state_, cost + more, audit + initial
    for _ in range(len(STATES)):
        if state in ends:
            return cost, audit
        state, cost, audit = DUE[state], cost + INSERT, audit + "I"
    return NEVER, ""


def search(found: str, start: str, ends: tuple[str, ...]) -> tuple[int, str] | None:
    """The least (cost, initials) from ``start`` to one of ``ends``; None if there is no way."""
    bounds = suffix_bounds(found)
    # The dive gives a cost to beat; its initials need not be the least of that cost. Where
    # it misses the end, that end keeps at most one row, and the rest goes.
    limit, _ = _dive(found, start, ends, bounds)
    limit = min(limit, DELETE * len(found)) if set(ends) <= {START, SYSTEM} else limit
    incumbent: tuple[int, str] | None = None
    dominance: dict[tuple[int, str], int] = {}
    stack: list[tuple[int, str, int, str]] = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if cost + bounds[at] > limit:
            continue
        if dominance.get((at, state), NEVER) <= cost:
            continue
        dominance[at, state] = cost
        if at == len(found) and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent, limit = (cost, audit), cost
        sign = found[at] if at < len(found) else None
        for initial, next_state, more, used in reversed(edits(state, sign)):
            stack.append((at + used, next_state, cost + more, audit + initial))
    return incumbent


@lru_cache(maxsize=1 << 12)
def solved(found: str, first: bool, last: bool) -> tuple[tuple[str, str, int, str], ...]:
    """(state before, state after, cost, initials) of a piece, for all that may matter."""
    rows = []
    for start in (START,) if first else STATES:
        for ends in (GOOD_ENDS,) if last else ((s,) for s in AFTER[start]):
            if ends == (SYSTEM,) and start == START and SYSTEM not in found.lower():
                continue
            if (best := search(found, start, ends)) is not None:
                rows.append((start, "." if last else ends[0], *best))
    return tuple(rows)


def joined(pieces: list[list[dict]]) -> list[tuple[str, str, int, str]]:
    """The same for neighbouring pieces together."""
    starts = {r["before"] for r in pieces[0]}
    rows = []
    for start in sorted(starts):
        reached = {start: (0, "")}
        for piece in pieces:
            after: dict[str, tuple[int, str]] = {}
            for r in piece:
                if r["before"] in reached:
                    cost, audit = reached[r["before"]]
                    way = (cost + r["cost"], audit + r["audit"])
                    after[r["after"]] = min(after.get(r["after"], way), way)
            reached = after
        rows += [(start, end, *best) for end, best in reached.items()]
    return rows


WAYS = "ways array<struct<before: string, after: string, cost: long, audit: string>>"
_WAYS = pa.list_(
    pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
)


def _with_ways(part: pa.RecordBatch, keys: tuple[str, ...], ways: list) -> pa.RecordBatch:
    names = ("before", "after", "cost", "audit")
    rows = [[dict(zip(names, way)) for way in found] for found in ways]
    return pa.RecordBatch.from_arrays(
        [*(part[k] for k in keys), pa.array(rows, _WAYS)], names=[*keys, "ways"]
    )


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        columns = [part[c].to_pylist() for c in ("signs", "first", "last")]
        yield _with_ways(part, ("conv_id", "piece"), [solved(*row) for row in zip(*columns)])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 16):
        found = [joined([p["ways"] for p in pieces]) for pieces in part["pieces"].to_pylist()]
        yield _with_ways(part, ("conv_id", "piece"), found)


def audits(marked: DataFrame, piece: int = PIECE, join: int = JOIN) -> DataFrame:
    """conv_id, cost and audit of the best repair of rows (conv_id, at, sign)."""
    shipped(marked.sparkSession)
    pieces = marked.groupBy("conv_id", F.floor(F.col("at") / piece).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sign"))), lambda r: r.sign), "").alias("signs")
    )
    pieces = written(pieces, "repair-pieces")
    ends = pieces.groupBy("conv_id").agg(F.max("piece").alias("end"))
    ends = written(ends, "repair-ends").withColumnRenamed("conv_id", "of")
    ways = written(
        pieces.join(ends, pieces["conv_id"].eqNullSafe(ends["of"]))
        .select("conv_id", "piece", "signs", (F.col("piece") == 0).alias("first"), (F.col("piece") == F.col("end")).alias("last"))
        .mapInArrow(_solve, f"conv_id long, piece long, {WAYS}"),
        "repair-ways",
    )
    most = ends.agg(F.max("end")).first()[0] or 0
    while most:
        most //= join
        groups = ways.groupBy("conv_id", F.floor(F.col("piece") / join).alias("piece")).agg(
            F.sort_array(F.collect_list(F.struct("piece", "ways"))).alias("pieces")
        )
        ways = written(groups.mapInArrow(_join, f"conv_id long, piece long, {WAYS}"), "repair-ways")
    return ways.select("conv_id", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"))


#: One row a conversation with its repair, or one of its rows in order.
STREAM = "conv_id long, at long, turn long, role string, text string, fault string, audit string, cost long"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
REPAIRED = "conv_id long, place long, turn long, edit string, role string, text string"


class Reader:
    """Follows one conversation's rows in order."""

    def __init__(self, conv_id, audit: str, cost: int) -> None:
        self.conv_id, self.audit, self.cost = conv_id, audit or "", cost or 0
        self.state, self.edit, self.places = START, 0, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.least = self.most = None
        self.turns = 0
        self.digest = hashlib.sha256()

    def _turn(self, turn, edit: str, role: str, text: str) -> tuple:
        self.digest.update(("\n" * bool(self.places) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.places += 1
        return self.conv_id, self.places - 1, turn, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            self.edit += 1
            self.state = DUE[self.state]
            yield self._turn(None, "I", ROLES[self.state], "")

    def row(self, turn, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            # Rows come by number, so an equal number is the one before.
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        yield from self.inserted()
        edit = self.audit[self.edit]
        self.edit += 1
        if edit == "K":
            self.state = initial
            yield self._turn(turn, edit, role, text)
        elif edit == "R":
            self.state = DUE[self.state]
            yield self._turn(turn, edit, ROLES[self.state], text)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, self.audit, self.digest.hexdigest()
        )


def _read(turns: bool):
    """Reads conversations in order; gives their repaired turns, or one row for each."""
    schema = pa.schema(
        [(n, pa.string() if kind == "string" else pa.int64()) for n, kind in (c.split() for c in (REPAIRED if turns else RESULT).split(", "))]
    )

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None

        def closed() -> list[tuple]:
            if reader is None:
                return []
            last = list(reader.inserted())
            return last if turns else [reader.result()]

        for part in slices(batches):
            out: list[tuple] = []
            names = ("conv_id", "at", "turn", "role", "text", "fault", "audit", "cost")
            for conv_id, at, turn, role, text, fault, audit, cost in zip(*(part[n].to_pylist() for n in names)):
                if at < 0:
                    out += closed()
                    reader = Reader(conv_id, audit, cost)
                else:
                    made = list(reader.row(turn, role, text, fault))
                    out += made if turns else []
            yield batch(out)
        yield batch(closed())

    return run


def _streamed(conversations: DataFrame, rows: DataFrame, turns: bool) -> DataFrame:
    marked = written(signs(rows), "repair-signs")
    best = audits(marked.select("conv_id", "at", "sign"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("of")).distinct()
    heads = ids.join(best, ids["of"].eqNullSafe(best["conv_id"]), "left").select(
        F.col("of").alias("conv_id"),
        F.lit(-1).cast("long").alias("at"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))],
        "audit",
        "cost",
    )
    body = marked.select(
        "conv_id", "at", "turn", "role", "text", "fault",
        F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("cost"),
    )
    return (
        heads.unionByName(body)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "at")
        .mapInArrow(_read(turns), REPAIRED if turns else RESULT)
    )


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: one row a turn, with the edit that made it."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return _streamed(rows, rows, turns=True)


def digest(conversations: DataFrame) -> DataFrame:
    """Per conversation what the damage did, what its repair costs and what it gives."""
    return _streamed(pick(conversations, conv_id="conv_id"), damaged(conversations), turns=False)


#: The least (cost, initials) for each last role, row by row, with all numbers of insertions.
SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS crc),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1),
      lambda i: CAST(ascii(key[i]) AS BIGINT))), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM keyed k, t),
    (VALUES (1), (2)) AS v(copy)
  WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), ids AS (SELECT DISTINCT conv_id FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM hurt
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN trimmed = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed
), added(state, after, k) AS (
  VALUES ('^', '^', 0), ('^', 'u', 1), ('^', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2),
    ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)
), edited(edit, state, after) AS (
  VALUES ('D', '^', '^'), ('D', 's', 's'), ('D', 'u', 'u'), ('D', 'a', 'a'), ('K', '^', 's'), ('K', '^', 'u'), ('K', 's', 'u'),
    ('K', 'u', 'a'), ('K', 'a', 'u'), ('R', '^', 'u'), ('R', 's', 'u'), ('R', 'u', 'a'), ('R', 'a', 'u')
), steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '^' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM ids
  UNION ALL
  SELECT conv_id, n, state, cost, audit FROM (
    SELECT s.conv_id, f.n, e.after AS state, s.cost + {INSERT} * i.k
        + CASE e.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {RETYPE} ELSE 0 END
        + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN {TRUNCATED} ELSE 0 END AS cost,
      s.audit || repeat('I', i.k) || e.edit AS audit
    FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1
    JOIN added i ON i.state = s.state JOIN edited e ON e.state = i.after
    WHERE (e.edit = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (e.edit <> 'K' OR f.initial = e.after)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, n, state ORDER BY cost, audit) = 1
), best AS (
  SELECT s.conv_id, cost + {INSERT} * i.k AS cost, audit || repeat('I', i.k) AS audit
  FROM steps s JOIN added i ON i.state = s.state AND i.after IN ('^', 'a')
  WHERE n = (SELECT count(*) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM s.conv_id)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + {INSERT} * i.k, audit || repeat('I', i.k)) = 1
), letters AS (
  SELECT conv_id, p, audit[p] AS edit, length(replace(left(audit, p), 'I', '')) AS n, length(replace(left(audit, p), 'D', '')) AS m
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM best)
), made AS (
  SELECT l.*, f.role, f.text, max(CASE WHEN l.m = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS has_system
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text FROM made WHERE edit <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost, b.audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""
