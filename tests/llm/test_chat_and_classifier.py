"""Chat windows read back exactly; the classifier on texts that differ; the whole pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflux.llm import chat_format, packing, pu_classifier, simhash
from folioflux.llm.common import written

PIECES = ["</s>", "[INST]", "[user]", "<s>", "\\", "\\o", "\\e[", "]", "<", " é日 ", "\n", "word ", "", "a" * 50]


def conversations():
    rng = random.Random(6)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 3 else rng.choice(["user", "assistant", "tool]<"])
            rows.append((conv, turn, role, "".join(rng.choice(PIECES) for _ in range(rng.randrange(25)))))
    rows += [(100, 0, None, None), (100, 0, None, None), (100, None, "assistant", "first"), (None, 1, "assistant", "x")]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(
        [(*r, 1) for r in conversations()], "conv_id long, turn long, role string, text string, window int"
    )


@pytest.mark.parametrize("budget, history", [(512, 128), (40, 12), (30, 0)])
def test_windows_read_back(turns, budget, history):
    windows = chat_format.format_windows(turns, budget, history)
    found = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    by_conv = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, *rest in conversations():
        by_conv.setdefault(conv, []).append((conv, *rest))
    assert found.keys() == by_conv.keys()
    for conv, rows in by_conv.items():
        rows.sort(key=key)
        everything = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
        loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        got = found[conv]
        assert got["n_turns"] == len(rows)
        assert got["turns_sha256"] == hashlib.sha256(everything.encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_budget_system_and_history(turns):
    budget, history = 60, 20
    for r in chat_format.format_windows(turns, budget, history).collect():
        marks = re.findall(r"\[([^\[\]]*)\]([^<]*)</s>", r["formatted"])
        assert r["formatted"] == "<s>" + "".join(f"[{a}]{b}</s>" for a, b in marks)
        sizes = [-(-len(_plain(b)) // 4) + 4 for _, b in marks]
        longest = max(sizes)
        if 2 * longest <= budget - history - (sizes[0] if marks[0][0] == "system" else 0):
            assert sum(sizes) <= budget
        repeated = sizes[: r["repeated_turns"]]
        if r["window"] and marks[0][0] == "system" and r["repeated_turns"]:
            repeated = repeated[1:]
        assert sum(repeated) <= history
        assert (r["window"] == 0) <= (r["repeated_turns"] == 0)


def _plain(text):
    for plain, code in reversed(chat_format.ESCAPES):
        text = text.replace(code, plain)
    return text


def test_no_conversation(turns):
    assert chat_format.read_back(chat_format.format_windows(turns.where("false"))).count() == 0


# ------------------------------------------------------------------ classifier


def corpus():
    rng = random.Random(11)
    words = ["river", "stone", "quiet", "house", "and", "the", "of", "morning", "letter", "garden"]
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        n = rng.randrange(20, 120)
        if good:
            text = " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
        else:
            text = " ".join(rng.choice(words).upper() + rng.choice(["!!", "###", " |"]) for _ in range(n))
        rows.append((i, text, i))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(700, None, 0), (701, "", 0), (None, "the river and the stone", 0), (1, "the quiet house", 0)]
    labels += [(701, None), (None, 1), (3, 0), (3, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def texts(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_classifier_on_held_out_rows(texts):
    docs, labels, truth = texts
    rows = pu_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        fold = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5
        assert r["held_out"] == (fold in (None, 0))
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in held if r["doc_id"] in truth and r["doc_id"] != 3]
    assert np.mean([p == t for p, t in judged]) >= 0.95
    kept = pu_classifier.only_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in rows if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == ids


def test_classifier_without_labels_or_rows(texts):
    docs, labels, _ = texts
    assert {r["score"] for r in pu_classifier.classify(docs, labels.where("false")).collect()} == {0.5}
    assert pu_classifier.classify(docs.where("false"), labels).count() == 0


def test_risk_estimate_stays_non_negative(texts):
    docs, labels, _ = texts
    rows = pu_classifier.measured(docs, labels)
    model = pu_classifier.fit(rows)
    table = [(r["positive"], np.array(r["x"])) for r in rows.collect()]
    x, positive = np.array([v for _, v in table]), np.array([p for p, _ in table])
    g = model.linear(x)
    prior = pu_classifier._prior(rows, model, len(x), positive.sum())
    loss = np.logaddexp(0, g)
    assert 0.05 <= prior <= 0.95
    assert loss.mean() - 0.5 * loss[positive].mean() >= 0


def test_minimum_with_the_estimated_prior_against_plain_descent(texts):
    """The risk that the fit ends at, and its constraint, by another optimiser on plain arrays."""
    docs, labels, _ = texts
    rows = pu_classifier.measured(docs, labels)
    model = pu_classifier.fit(rows)
    table = [(r["positive"], np.array(r["x"], dtype=float)) for r in rows.collect()]
    positive, x = np.array([p for p, _ in table]), np.array([v for _, v in table])
    n, n_positive = float(len(x)), float(positive.sum())
    start = pu_classifier.Model(model.middle, model.scale, np.zeros(pu_classifier.WIDTH + 1))
    first = pu_classifier._minimise(rows, start, 0.5, n, n_positive)
    prior = pu_classifier._prior(rows, first, n, n_positive)
    z = model.inputs(x)
    penalty = pu_classifier.PENALTY / n_positive * np.concatenate([[0.0], np.ones(pu_classifier.WIDTH)])

    def parts(w):
        g = z @ w
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[positive]).mean()
        risk = np.logaddexp(0, g).mean() - prior * g[positive].mean() + 0.5 * (penalty * w * w).sum()
        return risk, negative

    # Descent with momentum from zero; of the points that keep the constraint the best one.
    w, speed, best = np.zeros(len(penalty)), np.zeros(len(penalty)), np.inf
    for _ in range(6000):
        s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ s / n - prior * z[positive].mean(axis=0) + penalty * w
        speed = 0.9 * speed - 0.05 * gradient
        w = w + speed
        risk, negative = parts(w)
        best = min(best, risk) if negative >= 0 else best
    mine, negative = parts(model.weights)
    assert negative >= -1e-9
    assert mine <= best + 0.01


# -------------------------------------------------------------------- pipeline


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ga", "lo") for b in ("ran", "ten", "lis", "mor", "den")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = "\n".join(prose(25).capitalize() + "." for _ in range(5))
        if bad:
            text = " ".join(w.upper() + "!! ###" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(not bad)))
    item = prose(40)
    rows[1] = (1, rows[1][1] + "\n" + item)
    rows += [(1000, rows[2][1]), (1001, rows[3][1].replace("\n", " ") + " end")]
    rows += [(1002, rows[3][1].replace("\n", " "))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, print string, offset int"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), "p", 7) for d, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, sets = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        current = written(stage(spark, current, str(tmp_path)), f"test-{name}")
        sets.append(current)
    assert all(s.columns == docs.columns for s in sets[1:5])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in sets]
    assert not ids[1] & {i for i in range(0, 300, 5)} and len(ids[1] - ids[0]) == 0
    assert len(ids[1] & {i for i in range(300) if i % 5}) >= 235
    assert 1000 in ids[1] and 1000 not in ids[2]
    lengths = {r["doc_id"]: (len(r["text"]), r["n_chars"]) for r in sets[2].collect()}
    assert all(a == b for a, b in lengths.values())
    assert {r["component_id"] for r in simhash.near_duplicates(sets[2]).collect()} == ids[3]
    assert not {1001, 1002, 3} <= ids[3] and 1 in ids[3] and 1 not in ids[4]
    assert ids[4] == ids[3] - {1}
    packed = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in current.collect()}
    again = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pack(sets[4]).collect()}
    assert packed == again and {d for d, _, _ in packed} == ids[4]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32")
    assert whole.count() == len(packed)
    assert whole.where(F.col("doc_id").isNull()).count() == 0
