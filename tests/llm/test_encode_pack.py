import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioflux.llm import packing, token_files
from folioflux.llm.encode import WordEncoder, default_path
from folioflux.session import shared_folder

TEXTS = [
    "Hello, World! hello world",
    "",
    None,
    "don't 'S <|endoftext|> a\x1cb  c É́ İstanbul ΣΑΣ 12,5%",
    "word " * 3000,
    "x" * 5000,
    "Hello, World! hello world",
]


def reference_ids(text):
    tokenizer = Tokenizer.from_file(default_path())
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_encoder_equals_the_tokenizer():
    encoder, rng = WordEncoder(), random.Random(5)
    alphabet = "abZ éÉßſİ'<|>.,-12 \n\t\x0b\x1d\x85_~`\\[]{}^«Σ日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert encoder.encode_all(texts) == [encoder.whole(t) for t in texts]


def rows_of(spark):
    rows = [(i * 3 % 7, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "no id here", "clash", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int")


def test_token_files_round_trip(spark):
    folder = shared_folder(spark, "test-files")
    parts = token_files.write_token_files(rows_of(spark), folder)
    assert [p.base for p in parts] == list(np.cumsum([0] + [p.tokens for p in parts])[:-1])
    found = sorted(token_files.read_token_files(spark, parts, folder).collect(), key=lambda r: r["start"])
    texts = {i * 3 % 7: t for i, t in enumerate(TEXTS)} | {None: "no id here"}
    assert [r["doc_id"] for r in found] == [None, 0, 1, 2, 3, 4, 5, 6]
    start = 0
    for r in found:
        ids = reference_ids(texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_nothing(spark):
    folder = shared_folder(spark, "test-files")
    parts = token_files.write_token_files(rows_of(spark).where("false"), folder)
    assert parts == []
    assert token_files.read_token_files(spark, parts, folder).count() == 0


@pytest.mark.parametrize("window", [16, 2048])
def test_pack_places_each_id_once(spark, window):
    docs = rows_of(spark).union(rows_of(spark))
    found = packing.pack(docs, window, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {i * 3 % 7: t for i, t in enumerate(TEXTS)} | {None: "no id here"}
    for doc_id, pieces in by_doc.items():
        ids = reference_ids(texts[doc_id])
        assert sum(p["length"] for p in pieces) == 2 * len(ids)
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            assert p["ids"] == ids[p["start"] : p["start"] + p["length"]].tobytes()
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    assert packing.pack(docs.where("false"), window).count() == 0


def best_fill(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


def test_closest_fill_against_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        room = rng.randrange(0, 80)
        used = packing.closest_fill(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        lengths = [k for k, n in counts.items() for _ in range(n)]
        assert sum(k * n for k, n in used.items()) == best_fill(lengths, room)


def test_plan_uses_all_counts_with_little_padding():
    rng = random.Random(2)
    counts = {n: rng.randrange(0, 50) for n in range(1, 2049)}
    plan, used = packing.plan_windows(counts), defaultdict(int)
    for times, pattern in plan:
        assert sum(k * n for k, n in pattern.items()) <= 2048
        for k, n in pattern.items():
            used[k] += times * n
    assert dict(used) == {k: n for k, n in counts.items() if n}
    windows = sum(times for times, _ in plan)
    assert windows * 2048 <= 1.01 * sum(k * n for k, n in counts.items()) + 2048


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "words of a vocabulary")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(docs, str(tmp_path / "a"), width="<u1")
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(docs, str(tmp_path / "b"), end_id=70_000)
