"""Conversations as training windows, with column functions alone.

A window is ``<s>`` and then turns ``[role]text</s>``. Inside roles and texts the signs
that make up the marks are escaped (``\\e`` backslash, ``\\o`` ``[``, ``\\c`` ``]``,
``\\l`` ``<``), so a mark in a window is always a real one and the way back is exact.

The prefix sums of the turns' tokens decide the cuts: with ``C`` tokens a span, a turn
belongs to the span in which its last token falls, so spans are aligned to turns. ``C``
is what the budget leaves after the system turn, the history and the longest turn's
possible overhang (half of the rest at most), so a window stays within its budget unless
a single turn is longer than half of it; such a turn is kept whole.

A conversation's leading system turn stands at the head of each of its windows. The turns
of the span before, as far back as ``history`` tokens reach, are repeated in front of the
new ones. Repeated turns are masked: only assistant texts that are new in a window carry
loss, so each does so once. ``loss`` holds start and length of these texts in code points
of the window as formatted.

Defined cases: null roles and texts are empty; turns with the same number follow in the
order of role and text, null numbers first; equal rows are turns of their own; rows
without a ``conv_id`` are one conversation; an empty text is an empty turn; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.common import pick

HEAD, ROLE_OPEN, ROLE_CLOSE, END = "<s>", "[", "]", "</s>"
#: Backslash first here, last on the way back.
ESCAPES = (("\\", "\\e"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))

BUDGET, HISTORY = 512, 128
#: Tokens are reckoned: characters over this, rounded up, and the marks of a turn.
CHARS_PER_TOKEN, TURN_TOKENS = 4, 4


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reckoned_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN) + TURN_TOKENS


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, repeated_turns, loss array<struct<start, length>>."""
    if not 0 <= 2 * history < budget:
        raise ValueError("the history takes less than half of the budget")
    turns = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ("turn", "role", "text")
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    whole = Window.partitionBy("conv_id")

    placed = turns.withColumn("n", F.row_number().over(in_order)).select(
        "*",
        ((F.col("n") == 1) & (F.col("role") == "system")).alias("is_system"),
        F.concat(F.lit(ROLE_OPEN), escaped(F.col("role")), F.lit(ROLE_CLOSE)).alias("opening"),
        escaped(F.col("text")).alias("body"),
        reckoned_tokens(F.col("text")).alias("tokens"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("n")
    counted = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    summed = placed.select(
        "*",
        (F.sum(counted).over(by_turn) - counted).alias("before"),
        (F.sum(counted).over(by_turn)).alias("after"),
        F.sum(counted).over(whole).alias("total"),
        F.max(counted).over(whole).alias("longest"),
        F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(whole), F.lit(0)).alias("system"),
    )
    room = F.greatest(F.lit(2), F.lit(budget - history) - F.col("system"))
    span_tokens = room - F.least(F.col("longest"), F.floor(room / 2))
    spans = summed.withColumn(
        "span", F.when(~F.col("is_system"), F.floor((F.col("after") - 1) / span_tokens))
    )
    in_span = Window.partitionBy("conv_id", "span")
    # A window is known by the prefix sum at its start.
    starts = spans.select(
        "*",
        F.when(F.col("is_system"), F.lit(0)).otherwise(F.min("before").over(in_span)).alias("own"),
        F.max("after").over(in_span).alias("next"),
    )
    is_history = (
        ~F.col("is_system")
        & (F.col("next") < F.col("total"))
        & (F.col("next") - F.col("before") <= history)
    )
    uses = F.array_compact(
        F.array(
            F.struct(F.col("own").alias("start"), F.lit(False).alias("repeated")),
            F.when(is_history, F.struct(F.col("next").alias("start"), F.lit(True).alias("repeated"))),
        )
    )
    used = starts.withColumn("use", F.explode(uses)).select(
        "conv_id",
        "n",
        "role",
        "is_system",
        F.col("use.start").alias("start"),
        F.col("use.repeated").alias("repeated"),
        F.concat("opening", "body", F.lit(END)).alias("formatted"),
        F.length("opening").alias("opening_chars"),
        F.length("body").alias("body_chars"),
    )
    chars = F.length("formatted")
    within = Window.partitionBy("conv_id", "start").orderBy("n")
    offset = F.sum(chars).over(within) - chars
    mask = F.when(
        (F.col("role") == "assistant") & ~F.col("repeated"),
        F.struct(
            (F.col("offset") + F.col("opening_chars")).cast("long").alias("start"),
            F.col("body_chars").cast("long").alias("length"),
        ),
    )
    windows = (
        used.withColumn("offset", offset)
        .groupBy("conv_id", "start")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "formatted", mask.alias("loss")))).alias("turns"),
            F.count_if("repeated").alias("repeated"),
            F.max(F.when(F.col("is_system"), F.col("formatted"))).alias("system"),
        )
    )
    later = F.when(F.col("start") > 0, F.max("system").over(whole))
    headed = windows.select(
        "conv_id",
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("start")) - 1).cast("long").alias("window"),
        "turns",
        "repeated",
        later.alias("kept_system"),
    )
    head = F.concat(F.lit(HEAD), F.coalesce("kept_system", F.lit("")))
    losses = F.filter(F.col("turns.loss"), lambda x: x.isNotNull())
    return headed.select(
        "conv_id",
        "window",
        F.concat(head, F.array_join(F.col("turns.formatted"), "")).alias("formatted"),
        (F.col("repeated") + F.col("kept_system").isNotNull().cast("long")).alias("repeated_turns"),
        F.transform(
            losses,
            lambda x: F.struct(
                (x.start + F.length(head)).cast("long").alias("start"), x.length.alias("length")
            ),
        ).alias("loss"),
    )


def new_turns(formatted: Column, repeated: Column) -> Column:
    """The window's turns that no window before had, as (role, text)."""
    segments = F.split(F.substring(formatted, len(HEAD) + 1, 2**31 - 1), END)
    marked = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    fresh = F.filter(marked, lambda x, i: i >= repeated)
    parts = F.transform(fresh, lambda x: F.split(F.substring(x, 2, 2**31 - 1), ROLE_CLOSE, 2))
    return F.transform(
        parts,
        lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: turns, text under the mask, characters."""
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    masked = F.transform(
        "loss", lambda x: unescaped(F.substring(F.col("formatted"), x.start + 1, x.length))
    )
    parsed = windows.withColumn("turns", new_turns(F.col("formatted"), F.col("repeated_turns"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct("window", F.array_join(lines, "").alias("text")).alias("turns"),
        F.struct("window", F.array_join(masked, "").alias("text")).alias("loss"),
    )
    texts = parsed.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.sort_array(F.collect_list("turns")).getField("text"), "").alias("all_turns"),
        F.array_join(F.sort_array(F.collect_list("loss")).getField("text"), "").alias("all_loss"),
    )
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("all_turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("all_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("all_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, role)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    CAST(ceil(length(text) / {CHARS_PER_TOKEN}.0) AS BIGINT) + {TURN_TOKENS} AS tokens,
    length(role) + length(text) + {len(ROLE_OPEN + ROLE_CLOSE + END)}
      + length(regexp_replace(role || text, '[^\\\[\]<]', '', 'g')) AS chars
  FROM every
), counted AS (
  SELECT *, n = 1 AND role = 'system' AS is_system,
    CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE tokens END AS own FROM placed
), summed AS (
  SELECT *, sum(own) OVER w AS after, sum(own) OVER w - own AS before, sum(own) OVER c AS total,
    max(own) OVER c AS longest, coalesce(max(tokens) FILTER (is_system) OVER c, 0) AS system
  FROM counted WINDOW w AS (PARTITION BY conv_id ORDER BY n), c AS (PARTITION BY conv_id)
), spans AS (
  SELECT *, CASE WHEN NOT is_system THEN (after - 1) // (room - least(longest, room // 2)) END AS span
  FROM (SELECT *, greatest(2, {BUDGET - HISTORY} - system) AS room FROM summed)
), bordered AS (
  SELECT *, max(after) OVER s AS next,
    CASE WHEN is_system THEN 0 ELSE min(before) OVER s END AS start
  FROM spans WINDOW s AS (PARTITION BY conv_id, span)
), sizes AS (
  SELECT conv_id, count(DISTINCT start) AS windows, sum(chars) AS all_chars,
    sum(chars) FILTER (NOT is_system AND next < total AND next - before <= {HISTORY}) AS repeated,
    max(chars) FILTER (is_system) AS system_chars
  FROM bordered GROUP BY conv_id
)
SELECT p.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(s.windows * {len(HEAD)} + s.all_chars + coalesce(s.repeated, 0)
    + (s.windows - 1) * coalesce(s.system_chars, 0)) AS BIGINT) AS formatted_chars
FROM placed p JOIN sizes s USING (conv_id) GROUP BY p.conv_id
"""
