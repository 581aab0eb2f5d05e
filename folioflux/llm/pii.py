"""Personal data: expressions propose spans, checksums confirm, nearby words weigh in.

Each proposal starts with the score of its kind; a checksum that holds adds to it (Luhn
for cards, mod 97 for account numbers), and a word of the kind's context within
``NEARBY`` characters before it adds again. Kinds of the base (``email``, ``ip``,
``card``, ``phone``) are always kept, as their expression and validator settle them; the
kinds that only the method adds need a score of ``KEEP_FROM``, and give way where a base
span already lies: ``iban``; ``secret``, a long mixed word whose letters are as good as
random, near a word for a credential; and ``local_phone``, a number without country code.

An account number may run on into capitals after it. Where its country has a fixed length
(``ACCOUNT_LENGTHS``), that end is checked; else all ends at a word's end, longest first.

Every search is linear in the text, so long texts of one character class are no trap.

Defined cases: a null text counts as empty; a text without spans gives zero counts and
an empty list; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import pick, shipped, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "secret", "local_phone")
RANK = {kind: i for i, kind in enumerate(KINDS + MORE_KINDS)}

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where a run of digits fails, so does each of its ends; so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,6}(?![0-9A-Za-z])")
DIGIT = re.compile("[0-9]")

SECRET = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{16,512}(?![A-Za-z0-9_+/=.-])")
#: Bits a character that a random value has and a word or number has not.
RANDOM_BITS = 3.0
# Characters of an account number by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}

SCORES = {"secret": 0.2, "email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "local_phone": 0.2}
CONFIRMED, IN_CONTEXT, KEEP_FROM, NEARBY = 0.5, 0.4, 0.6, 40
RANDOM = 0.2
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel)"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fon|fax|mobile?|handy|anruf)"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)"),
    "secret": re.compile(r"(?i)(?:\b|_)(?:tokens?|secrets?|passwor[dt]e?|passwd|pwd|bearer|auth\w*|credentials?|api[ _-]?key|access[ _-]?key|key|schl(?:ü|ue)ssel|clave|contrase(?:ñ|n)a|clef?|mot de passe|kennwort)\b"),
    "local_phone": re.compile(r"(?i)\b(?:tel|phone|call|telefon|fax|mobile|handy|anruf)"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose mod 97 holds, each at the end that is right for it."""
    m = IBAN.search(text)
    while m:
        low, high = m.span()
        # Ends at which a word ends, by how many characters without blanks they hold.
        ends, count = {}, 0
        for i in range(low, high):
            count += text[i] != " "
            if text[i] != " " and not (i + 1 < len(text) and text[i + 1].isascii() and text[i + 1].isalnum()):
                ends[count] = i + 1
        length = ACCOUNT_LENGTHS.get(m[0][:2])
        tried = [length] if length else sorted((n for n in ends if 15 <= n <= 34), reverse=True)
        end = next((ends[n] for n in tried if n in ends and mod97(text[low : ends[n]].replace(" ", ""))), None)
        if end is not None:
            yield low, end
        m = IBAN.search(text, low + 4 if end is None else end)


def looks_random(word: str) -> bool:
    """Letters and digits mixed, with about as many different ones as chance gives."""
    if not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
        return False
    counts = [n / len(word) for n in Counter(word.lower()).values()]
    return -sum(n * log2(n) for n in counts) >= RANDOM_BITS


def _run_before(text: str, low: int, at: int) -> int:
    """Where the run of local-part characters that ends at ``at`` starts."""
    size = 64
    while True:
        start = max(low, at - size)
        left = at - len(text[start:at]) + len(text[start:at].rstrip(LOCAL_PART))
        if left > start or start == low:
            return left
        size *= 4


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = _run_before(text, low, at)
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
        else:
            low = at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds; what fails its validator is dropped."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the other kinds that no base span touches, each with its score."""
    if not DIGIT.search(text):
        return []
    # Ends of the spans so far, as far as each start reaches.
    taken = sorted((a, b) for _, a, b in base)
    reach = []
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)

    def free(a: int, b: int) -> bool:
        i = bisect_right(taken, (b - 1, float("inf")))
        return not i or reach[i - 1] <= a

    found = [("iban", *span) for span in accounts(text) if free(*span)]
    for m in SECRET.finditer(text):
        if looks_random(m[0]) and free(*m.span()):
            found.append(("secret", *m.span()))
    # Both lists go by start, so one walk along them finds what touches.
    others = sorted((a, b) for _, a, b in found)
    at, until = 0, 0
    for m in LOCAL_PHONE.finditer(text):
        a, b = m.span()
        while at < len(others) and others[at][0] < b:
            until, at = max(until, others[at][1]), at + 1
        if 7 <= sum(c.isdigit() for c in m[0]) <= 12 and until <= a and free(a, b):
            found.append(("local_phone", a, b))
    return [s for s in found if score(text, *s) >= KEEP_FROM]


def score(text: str, kind: str, start: int, end: int) -> float:
    """Between 0 and 1: the kind's own, more with a checksum, more in context."""
    value = SCORES[kind] + (CONFIRMED if kind in ("card", "iban") else RANDOM if kind == "secret" else 0.0)
    if CONTEXT[kind].search(text, max(0, start - NEARBY), start):
        value += IN_CONTEXT
    return min(1.0, round(value, 2))


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """All kept spans by start, then kind, each with its score."""
    base = base_spans(text)
    spans = base + added_spans(text, base)
    spans.sort(key=lambda s: (s[1], RANK[s[0]]))
    return [(*s, score(text, *s)) for s in spans]


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>, masked string"


def find(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row its spans and, if asked, the text with each span replaced by its kind."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, texts = [], []
            for text in batch["text"].to_pylist():
                spans = spans_of(text)
                rows.append([dict(zip(("kind", "start", "end", "score"), s)) for s in spans])
                texts.append(masked(text, spans) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "spans", "masked"],
            )

    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    return rows.mapInArrow(run, SPANS)


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts and the joined spans of what ``find`` returns."""
    def joined(spans):
        text = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end))
        return F.array_join(text, ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(of(*KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
