"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are which n-grams it has (SHORTEST <= n <= LONGEST, hashed). Each is scaled by the log of the ratio
of its smoothed frequencies among texts of label 1 and of label 0, and a logistic regression with an L2 penalty is
fitted on the scaled features, with the labels weighted to their shares among all labelled rows. Since few rows fit many
features too well, the margins of rows that a fit has not seen, fold by fold, set the slope and offset that make a score of
the final margins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import fold, ready, release, tidy
from quillmark.llm.ngrams import BITS, bins, sampled, squash

SHORTEST, LONGEST = 3, 6
#: Bounds of what is learnt from: rows of a label, characters of a text.
PER_LABEL, CHARACTERS = 2_500, 20_000
#: Smoothing of the counts, least texts and least absolute ratio of an n-gram that counts, penalty, rounds of the fit, folds.
SMOOTH, LEAST_TEXTS, LEAST_RATIO, LOOSE, PENALTY, ROUNDS, FOLDS = 1.0, 3, 1.5, 0.7, 1e-5, 150, 3
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray  # of each bin, the ratio included
    offset: float

    def score(self, text: str | None) -> float:
        return float(squash(self.weights[bins(text or "", SHORTEST, LONGEST)].sum(dtype=np.float64) + self.offset))


def ratios(each: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """From the texts of each label that have a feature, and the texts of each: the log-count ratios, and which count."""
    rate = [(n + SMOOTH) / (k + 2 * SMOOTH) for n, k in zip(each, rows)]
    ratio = np.log(rate[1] / rate[0])
    return ratio, (each[0] + each[1] >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)


def regress(flat: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, columns: int) -> tuple[np.ndarray, float]:
    """Weights of the columns (ratio included) and offset, from entries (flat: column, of: row) of rows with label y."""
    each = [np.bincount(flat[y[of] == k], minlength=columns) for k in (0, 1)]
    ratio, used = ratios(each, [int((y == k).sum()) for k in (0, 1)])
    scale, weight = np.where(used, ratio, 0.0), weight / weight.sum()
    sums = lambda w: np.bincount(of, weights=w[flat], minlength=len(y))
    share = float(np.clip(weight @ y, 1e-4, 1 - 1e-4))
    # accelerated gradient steps on the mean logistic loss
    step = 4 / max(1.0, float(weight @ sums(scale * scale)) + 1)
    w, b, last = np.zeros(columns), float(np.log(share / (1 - share))), np.zeros(columns)
    last_b = b
    for t in range(ROUNDS):
        m = t / (t + 3)
        u, ub = w + m * (w - last), b + m * (b - last_b)
        error = weight * (squash(sums(u * scale) + ub) - y)
        gradient = np.bincount(flat, weights=error[of], minlength=columns) * scale + PENALTY * u
        last, last_b, w, b = w, b, u - step * gradient, ub - step * float(error.sum())
    return w * scale, b


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Slope and offset for the margins z: the slope is that of the logistic regression of y on z; the offset puts the
    threshold where z tells the labels apart best by F2, since a miss weighs more than a false flag. (1, 0) if the
    margins say nothing."""
    x, c = np.column_stack([z, np.ones(len(z))]), np.zeros(2)
    for _ in range(50):
        p = squash(x @ c)
        c -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - y)) + 1e-6 * c)
    if c[0] <= 0:
        return 1.0, 0.0
    order = np.argsort(-z, kind="stable")
    right, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int(np.argmax(5 * right / (4 * right[-1] + all_)))
    at = (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    return float(c[0]), float(np.log(threshold / (1 - threshold)) - c[0] * at)


def learn(rows: list[tuple[int, str, int]], share: float | None = None) -> Model:
    """rows: (id, text, label 0 or 1), a bounded sample; share: of label 1 among all labels, by default as in rows.

    With one label or none, every score is that label's or 0. Each text's n-grams are found twice: to count them, then
    to keep those that count.
    """
    y = np.array([int(r[2]) for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if len(y) and y[0] else -40.0)
    each = [np.zeros(1 << BITS, dtype=np.int32) for _ in (0, 1)]
    for r in rows:
        each[int(r[2])][bins(r[1], SHORTEST, LONGEST)] += 1
    ratio = ratios(each, [int((y == k).sum()) for k in (0, 1)])[0]
    used = np.flatnonzero((each[0] + each[1] >= LEAST_TEXTS) & (np.abs(ratio) >= LOOSE * LEAST_RATIO))  # more than count in the end: a fold's choice is its own
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    found = []
    for r in rows:
        c = column[bins(r[1], SHORTEST, LONGEST)]
        found.append(c[c >= 0])
    flat, of = np.concatenate(found), np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in found])
    share = float(y.mean() if share is None else min(max(share, 1e-4), 1 - 1e-4))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    part, z = np.array([zlib.crc32(f"fold {r[0]}".encode()) % FOLDS for r in rows]), np.zeros(len(rows))
    for k in range(FOLDS):
        seen = part != k
        if len(set(y[seen].tolist())) == 2:
            nth, inside = np.cumsum(seen) - 1, seen[of]
            w, b = regress(flat[inside], nth[of[inside]], y[seen], weight[seen], len(used))
            z[~seen] = (np.bincount(of, weights=w[flat], minlength=len(rows)) + b)[~seen]
    w, b = regress(flat, of, y, weight, len(used))
    slope, offset = calibration(z, y, weight)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = slope * w
    return Model(weights, slope * b + offset)


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2)) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic), outside the held-out fold of the ids."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        rows = rows.filter(fold(F.col("doc_id"), held_out[0]) != held_out[1])
    share = rows.agg(F.avg("toxic")).first()[0]
    try:
        return learn(sampled(docs, rows, "toxic", PER_LABEL, CHARACTERS, 2 * PER_LABEL), share)
    finally:
        release()


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) of each row of docs (columns doc_id, text; others
    are ignored).

    A null text is scored as an empty one. Repeated rows give repeated rows, equal texts equal values; an empty table
    gives none.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: one weight for each bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = np.array([m.score(t) for t in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda batches: (b.map(shared.value.score) for b in batches))(texts)

    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out fold and score all of docs: doc_id, held_out, score, predicted."""
    return predict(docs, fit(docs, labels)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
