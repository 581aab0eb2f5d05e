"""Quality from positive and unlabelled texts.

Trusted positives P are the labelled rows of quality 1; unlabelled texts U are all
documents. With the logistic loss the unbiased risk of a linear score g is

    R(g) = pi * mean_P[loss(g)] + ( mean_U[loss(-g)] - pi * mean_P[loss(-g)] )

whose second part estimates the risk on negatives and must not fall below zero: a step
that would take it there is shortened, so the fit stays at non-negative estimates. As
loss(g) - loss(-g) = -g, R is convex, and damped Newton steps reach its minimum in a few
rounds. Each round sums gradient and curvature over all rows inside the tasks; the driver
gets a few thousand sums whatever the number of rows.

The class prior pi is estimated from a first score that only tells P from U: where the
texts look most like positives, U holds hardly any negatives, so the share of U above a
score over the share of P above it comes close to pi; its least value over the thresholds
above which three tenths of P lie is taken. The penalty on the weights is ten over the
number of positives, so few labels do not tell the texts from themselves.

Inputs are counts and shares taken from the whole text, never labels, language, source
or id. Rows whose crc32(id as text) mod 5 is 0 give no label.

Defined cases: a null text counts as empty and gets a score like any other; a document
labelled both ways is no trusted positive; rows with the same id share its label; with no
trusted positive, or no document, every score is the prior 0.5; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import pick, shipped, slices, text_or_empty, written

FOLDS = 5
PREDICT_FROM = 0.3
ROUNDS = 15
#: Of the squared weights, over the number of positives.
PENALTY = 10.0
#: Share of the positives that must lie above a threshold used for the prior.
PRIOR_TAIL = 0.3
SCORE_BINS = 400

MARKS = "#*$%&|<>"


def measures(text: str) -> list[float]:
    """Counts and shares of one whole text, each on a scale where a step means much."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, chars = len(words), len(text)
    per_word, per_line, per_char = 1 / max(n, 1), 1 / max(len(lines), 1), 1 / max(chars, 1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if n else 0
    lengths = np.fromiter(map(len, words), np.float64, n)
    pairs = len(set(zip(words, words[1:])))
    marks = sum(text.count(c) for c in MARKS)
    upper = sum(map(str.isupper, words))
    titled = sum(map(str.istitle, words))
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    commas = text.count(",")
    bars = text.count("|")
    shouts = text.count("!")
    digits = sum(text.count(c) for c in "0123456789")
    letters = len(text) - text.count(" ") - text.count("\n")
    ascii_share = len(text.encode("ascii", "ignore")) * per_char

    def log(share: float) -> float:
        return math.log1p(100 * share)

    return [
        math.log1p(n),
        math.log1p(chars),
        math.log1p(len(lines)),
        log(marks * per_word),
        log(bars * per_word),
        log(shouts * per_word),
        log(upper * per_word),
        log(titled * per_word),
        log(stops * per_word),
        log(commas * per_word),
        log(digits * per_char),
        log(1 - ascii_share),
        log(1 - len(counts) * per_word),
        log(1 - pairs / max(n - 1, 1)),
        log(top * per_word),
        log((len(lines) - len(set(lines))) * per_line),
        math.log1p(n * per_line),
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        math.log1p(float(lengths.max())) if n else 0.0,
        log(float((lengths <= 3).mean())) if n else 0.0,
        log(float((lengths >= 12).mean())) if n else 0.0,
        log(letters * per_char),
        1.0 if n < 10 else 0.0,
        1.0 if n < 30 else 0.0,
        log(sum(c.isdigit() for c in counts) * per_word),
        log((text.count("@") + text.count("http")) * per_word),
        log(sum(not c[0].isalpha() for c in counts) * per_word),
        log(sum(not (c[-1].isalpha() or c[-1] in ".,") for c in counts) / max(len(counts), 1)),
    ]


WIDTH = len(measures(""))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measures(text) for text in batch["text"].to_pylist()]
        values = pa.array(np.array(rows, dtype=np.float32).reshape(-1), pa.float32())
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "x"]
        )


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, positive and the measures of every document."""
    shipped(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    trusted = (
        pick(labels, doc_id="doc_id", quality="quality")
        .where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 1).alias("good"))
        .where("good")
    )
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    held_out = F.coalesce(fold == 0, F.lit(True))
    return written(
        rows.mapInArrow(_measure, "doc_id long, x array<float>")
        .join(trusted, "doc_id", "left")
        .select(
            "doc_id",
            held_out.alias("held_out"),
            (F.coalesce("good", F.lit(False)) & ~held_out).alias("positive"),
            "x",
        ),
        "pu-measures",
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch["x"].flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, WIDTH)


def _sums(rows: DataFrame, size: int, of) -> np.ndarray:
    """Sums over all rows of what ``of(matrix, positive)`` gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                positive = batch["positive"].to_numpy(zero_copy_only=False).astype(bool)
                total += of(_matrix(batch), positive)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "value"])

    parts = rows.select("positive", "x").mapInArrow(run, "i long, value double")
    out = np.zeros(size)
    for row in parts.groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row["i"]] = row["value"]
    return out


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, g)


class Model:
    """A linear score on scaled measures."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.middle, self.scale, self.weights = middle, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.middle) / self.scale], axis=1)

    def linear(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.linear(x), -30, 30)))


def _minimise(rows: DataFrame, start: Model, prior: float, n: float, n_positive: float) -> Model:
    """Newton steps on the non-negative risk from the start's weights."""
    size, steps = WIDTH + 1, 0.5 ** np.arange(8)
    penalty = PENALTY / n_positive * np.concatenate([[0.0], np.ones(WIDTH)])
    model = start
    for _ in range(ROUNDS):

        def slope(x: np.ndarray, positive: np.ndarray, model: Model = model) -> np.ndarray:
            z, s = model.inputs(x), model.scores(x)
            curve = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate([s @ z, z[positive].sum(axis=0), curve.ravel()])

        sums = _sums(rows, 2 * size + size * size, slope)
        w = model.weights
        gradient = sums[:size] / n - prior * sums[size : 2 * size] / n_positive + penalty * w
        if np.abs(gradient).max() < 1e-4:
            break
        curve = sums[2 * size :].reshape(size, size) / n + np.diag(penalty + 1e-6)
        step = np.linalg.solve(curve, gradient)
        tried = [model, *(Model(model.middle, model.scale, w - t * step) for t in steps)]

        def risks(x: np.ndarray, positive: np.ndarray, tried: list[Model] = tried) -> np.ndarray:
            g = np.stack([m.linear(x) for m in tried])
            return np.concatenate(
                [_softplus(g).sum(axis=1), g[:, positive].sum(axis=1), _softplus(g[:, positive]).sum(axis=1)]
            )

        on_all, linear, on_positive = _sums(rows, 3 * len(tried), risks).reshape(3, -1)
        shrink = np.array([0.5 * (penalty * m.weights**2).sum() for m in tried])
        risk = on_all / n - prior * linear / n_positive + shrink
        negative = on_all / n - prior * on_positive / n_positive
        allowed = [i for i in range(1, len(tried)) if risk[i] < risk[0] and negative[i] >= 0]
        if not allowed:
            break
        model = tried[allowed[0]]
    return model


def _prior(rows: DataFrame, model: Model, n: float, n_positive: float) -> float:
    """The least share of all texts over share of the positives above a score."""

    def counts(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((model.scores(x) * SCORE_BINS).astype(int), SCORE_BINS - 1)
        both = [np.bincount(b, minlength=SCORE_BINS) for b in (at, at[positive])]
        return np.concatenate(both).astype(np.float64)

    every, good = _sums(rows, 2 * SCORE_BINS, counts).reshape(2, -1)
    above, good_above = np.cumsum(every[::-1]) / n, np.cumsum(good[::-1]) / n_positive
    use = good_above >= PRIOR_TAIL
    return float(np.clip((above[use] / good_above[use]).min(), 0.05, 0.95))


def fit(rows: DataFrame) -> Model:
    """A model from the rows of ``measured``."""

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = _sums(rows, 2 + 2 * WIDTH, moments)
    n, n_positive = sums[:2]
    flat = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))
    if not n or not n_positive:
        return flat
    middle = sums[2 : 2 + WIDTH] / n
    scale = np.sqrt(np.maximum(sums[2 + WIDTH :] / n - middle**2, 0)) + 1e-6
    start = Model(middle, scale, np.zeros(WIDTH + 1))
    # With a prior of a half the same risk tells the positives from all texts.
    first = _minimise(rows, start, 0.5, n, n_positive)
    return _minimise(rows, start, _prior(rows, first, n, n_positive), n, n_positive)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every document."""
    rows = measured(docs, labels)
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= PREDICT_FROM).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.select("doc_id", "held_out", "x").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    model = fit(measured(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([measures(text) for text in texts]).reshape(-1, WIDTH)
        return pd.Series(model.scores(rows))

    return docs.where(score(F.coalesce(docs["text"].cast("string"), F.lit(""))) >= PREDICT_FROM)
