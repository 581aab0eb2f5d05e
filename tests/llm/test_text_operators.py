"""Line deduplication, quality rules, personal data and decontamination against plain code."""

import random
import re
from collections import Counter

import duckdb
import pytest

from folioflux.llm import decontam, line_dedup, pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")

ROWS = [
    (1, "a line\nb line\nc line\nd line"),
    (2, "x\na line\n\n b line \nc line\nd line\ny"),
    (2, "x\na line\n\n b line \nc line\nd line\ny"),
    (3, "a line\nb line\nz"),
    (4, "r\nr\nr\nr\nr\nr"),
    (5, None),
    (6, ""),
    (7, "c line\nd line\ny"),
    (8, "a line\nb line\nc line\nd line"),
]


def frame(spark, rows):
    extra = [(d, t, "src", i, "x") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, spans int, high string")


# ------------------------------------------------------------------ line dedup


def test_line_dedup_equals_sql(spark):
    docs = frame(spark, ROWS)
    found = line_dedup.remove_repeated(docs)
    assert found.columns == [*docs.columns, "lines_removed"]
    mine = Counter((r["doc_id"], r["text"] or "", r["lines_removed"]) for r in found.collect())
    documents = docs.toPandas()  # noqa: F841 - read by the SQL
    theirs = Counter(duckdb.sql(line_dedup.SQL).fetchall())
    assert mine == theirs
    assert (2, "x\ny", 5) in mine and (4, "r", 5) in mine and (8, "", 4) in mine


def test_line_dedup_of_ids_that_lack_or_repeat(spark):
    rows = [(None, "p\nq\nr"), (5, "p\nq\nr\ns"), (5, "other\ntext\nhere"), (None, None)]
    found = {(r["doc_id"], r["text"]) for r in line_dedup.remove_repeated(frame(spark, rows)).collect()}
    assert found == {(None, ""), (5, "p\nq\nr\ns"), (5, "other\ntext\nhere"), (None, None)}
    assert line_dedup.remove_repeated(frame(spark, rows).where("false")).count() == 0


def test_line_dedup_keeps_one_copy_of_each_line(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    kept = line_dedup.remove_repeated(frame(spark, rows)).collect()
    lines = {x for r in kept for x in r["text"].split("\n")}
    assert lines >= {x for _, t in rows for x in t.split("\n") if x}


# --------------------------------------------------------------- quality rules


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated),
    )


def test_base_counts():
    rng = random.Random(2)
    texts = ["", " \n", "a\x1cb\x85c\xa0d", "w " * 40, "é|<\n\né|<\nx"]
    texts += ["".join(rng.choice("abc  \n\t#é") for _ in range(rng.randrange(200))) for _ in range(200)]
    for text in texts:
        assert quality_rules.base_counts(text) == plain_counts(text), repr(text)


def test_frequent_lines_deplete(spark):
    own = "this text has ten words of its own number {} here now"
    rows = [(i, f"Cookie  notice 1{i % 10}\n" + own.format(chr(97 + i))) for i in range(12)]
    rows += [(20 + i, "Cookie notice 77\n" + "Cookie notice 9 " * i) for i in range(1, 6)]
    rows += [(30, own), (30, own), (31, None), (None, "few words")]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, least_many=5).collect()}
    assert all(found[i]["kept"] and found[i]["removed_words"] == 3 for i in range(12))
    assert not found[21]["kept"] and found[30]["kept"]
    assert found[31]["base_failed"] and not found[None]["kept"]
    assert quality_rules.apply_rules(docs, least_many=5).count() == len(rows)
    clean = quality_rules.without_frequent_lines(docs, least_many=5)
    assert clean.columns == docs.columns
    assert {r["text"] for r in clean.where("doc_id < 12").collect()} == {own.format(chr(97 + i)) for i in range(12)}
    assert quality_rules.apply_rules(docs.where("false")).count() == 0


def test_exact_copies_are_one_document(spark):
    rows = [(i, "the same ten words stand in each of these copies") for i in range(30)]
    assert quality_rules.apply_rules(frame(spark, rows), least_many=5).where("kept").count() == 30


# --------------------------------------------------------------- personal data

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(9)
    pieces = ["a.b@c.de", "@", "x@y", ".com", "1.2.3.4", "999.1.1.1", "0001.2.3.4.5", "+49 (30) 1234567",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "12", " ", ".", "-", "é", "a@b.c@d.e", "1" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        spans = [s[:3] for s in pii.spans_of(text) if s[0] in pii.KINDS]
        assert spans == plain_spans(text), repr(text)


def test_searches_stay_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000):
        pii.spans_of(text)


def test_checksums_and_context():
    kinds = lambda text: [s[0] for s in pii.spans_of(text)]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert kinds("Tel. 030 1234567") == ["local_phone"] and kinds("Article 030 1234567") == []
    (card,) = pii.spans_of("my card: 4111 1111 1111 1111")
    assert card[3] > pii.spans_of("4111 1111 1111 1111")[0][3]


def test_pii_rows(spark):
    docs = frame(spark, [(1, "mail a@b.co or a@b.co"), (2, None), (2, "é +49 30 12345678"), (None, "")])
    rows = pii.digest(pii.find(docs)).collect()
    assert sorted((r["spans"] for r in rows)) == ["", "", "email:5:11,email:15:21", "phone:2:17"]
    masked = {r["masked"] for r in pii.find(docs).collect()}
    assert masked == {"mail <email> or <email>", "", "é <phone>"}
    assert pii.find(docs.where("false")).count() == 0


# ------------------------------------------------------------- decontamination


def least_distance(pattern, text):
    """Sellers' table: the pattern against any stretch."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        above, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(above[j] + (c != d), above[j + 1] + 1, row[j] + 1))
    return min(row)


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(letters)), rng.random()
        if what < 0.4:
            letters[at] = rng.choice("xyzäq")
        elif what < 0.7:
            del letters[at]
        else:
            letters.insert(at, rng.choice("xyzäq "))
    return "".join(letters)


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        mine = decontam.best_distance(decontam.masks(pattern), len(pattern), text)
        assert mine == least_distance(pattern, text)


def test_finder_equals_comparing_everywhere():
    rng = random.Random(8)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "the", "river", "stone", "quiet", "house"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randrange(5, 30))) for i in range(12)]
    finder = decontam.Finder(items)
    for _ in range(60):
        number, item = rng.choice(items)
        edits = rng.randrange(0, decontam.budget(len(item)) + 4)
        text = prose(20) + " " + edited(rng, item, edits).upper().replace(" ", " \n") + " " + prose(15)
        expected = {}
        for i, t in items:
            distance = least_distance(t, decontam.plain(text))
            if distance <= decontam.budget(len(t)):
                expected[i] = distance
        assert finder.find(text) == expected


@pytest.mark.parametrize("chars", [decontam.BLOCK_CHARS, 40])
def test_hits_and_only_clean(spark, chars):
    items = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog today"), (2, None), (3, " \n"), (4, "ab cd"),
         (5, "an item that no document holds at all, not a bit of it")],
        "item_id long, text string",
    )
    docs = frame(spark, [
        (1, "So THE quick  brown\nfox jumps over the lazy dog todai!"), (2, None), (3, "xab cd"), (4, "x ab cd."),
        (4, "x ab cd."), (None, "nothing of the kind"),
    ])
    found = sorted(map(tuple, decontam.hits(docs, items, chars).collect()))
    assert found == [(1, 1, 1), (4, 4, 0), (4, 4, 0)]
    clean = decontam.only_clean(docs, items, chars)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 2, 3]
    assert decontam.hits(docs, items.where("false")).count() == 0
    assert decontam.hits(docs.where("false"), items).count() == 0


def kept_lines(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r["doc_id"]: r["removed_words"] for r in quality_rules.apply_rules(docs, **limits).collect()}


def test_line_limit_is_a_share_of_the_host(spark):
    """The same verdicts for a host of four times the documents, and for hosts side by side."""
    def rows(count, source, first):
        texts = []
        for i in range(count):
            lines = [f"own words of {source} {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} {'uvwxyz'[i // 100]} that stand here"]
            lines += ["half of all have this line"] * (i % 2 == 0) + ["a tenth has that one"] * (i % 10 == 0)
            texts.append((first + i, "\n".join(lines), source))
        return texts

    limits = {"most_share": 0.2, "least_many": 3}
    small, large = rows(40, "small", 0), rows(160, "large", 1000)
    removed = kept_lines(spark, small + large, **limits)
    assert {removed[i] for i in range(0, 40, 2)} == {6} and {removed[1000 + i] for i in range(0, 160, 2)} == {6}
    assert not any(removed[i] for i in range(1, 40, 2)) and not any(removed[1000 + i] for i in range(1, 160, 2))
    # Below the floor nothing goes, whatever the share.
    assert not any(kept_lines(spark, small[:6], **limits).values())


def test_copies_may_count_as_documents(spark):
    rows = [(i, "the same text for all of them\nand one more line of it", "h") for i in range(10)]
    rows += [(100 + i, f"text {chr(97 + i)} of its own words", "h") for i in range(10)]
    limits = {"most_share": 0.3, "least_many": 2}
    assert not any(kept_lines(spark, rows, **limits).values())
    counted = kept_lines(spark, rows, copies_count=True, **limits)
    assert counted[0] == 13 and counted[100] == 0


def test_accounts_before_capitals_and_in_a_row():
    def found(text):
        return [(kind, text[a:b]) for kind, a, b, _ in pii.spans_of(text) if kind == "iban"]

    british, german = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    assert found(f"IBAN {british} AND more") == [("iban", british)]
    assert found(f"konto {german} BIC COBADEFF") == [("iban", german)]
    assert found(f"{british} {german} XX") == [("iban", british), ("iban", german)]
    assert found("DE89370400440532013000,GB82WEST12345698765432") == [
        ("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432")
    ]
    # A country without a fixed length: the longest end whose sum holds.
    body = "XK051212012345678906"
    assert pii.mod97(body) and found(f"account {body} AB") == [("iban", body)]
    assert found("GB82 WEST 1234 5698 7654 33 AND") == [] and found("GB82 WEST 1234 5698 7654 32A") == []


def test_secrets_need_chance_and_context():
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [s[0] for s in pii.spans_of(f'token = "{value}"')] == ["secret"]
    assert [s[0] for s in pii.spans_of(f"my_api_key: {value}")] == ["secret"]
    # Neither a checksum without context, nor a long word or number in it.
    assert pii.spans_of(f"commit {value}") == []
    assert pii.spans_of("password: unbelievablyunforgettable") == []
    assert pii.spans_of("token aaaaaaaaaaaaaaaaaaaaaaaa1") == []


def test_many_numbers_and_accounts_in_one_text():
    text = "tel 030 1234567, IBAN DE89 3704 0044 0532 0130 00 und " * 3000
    kinds = [s[0] for s in pii.spans_of(text)]
    assert kinds.count("iban") == 3000 and kinds.count("local_phone") == 3000
