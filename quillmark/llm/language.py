"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (blended: n from 1 to LONGEST) that both have, over the
root of the product of their own numbers. It is approximated with landmark texts (Nystroem): a text's features are its
kernels with the landmarks times the inverse root of the landmarks' own kernel matrix. On these, kernel ridge
regression gives one score for each language against the rest. Scoring is by batches: a 0/1 matrix of texts by the
landmarks' n-grams, times the landmarks' matrix, times the regression weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import fold, ready, release, tidy
from quillmark.llm.ngrams import BITS, bins, sampled

LONGEST = 4
#: Bounds of what is learnt from: rows of a language, rows and landmarks in all, characters of a text. Texts scored at a time.
PER_LANGUAGE, ROWS, LANDMARKS, CHARACTERS, TEXTS_AT_ONCE = 200, 4_000, 128, 8_000, 64
RIDGE, SHARPNESS = 1e-2, 6.0
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # bin -> column of the landmarks' n-grams, or -1
    landmarks: np.ndarray  # columns x landmarks, scaled by each landmark's own norm
    weights: np.ndarray  # landmarks x languages
    offset: np.ndarray

    def kernels(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernels of texts, given by their bins, with the landmarks."""
        have = np.zeros((len(found), self.landmarks.shape[0]), dtype=np.float32)
        for i, b in enumerate(found):
            c = self.column[b]
            have[i, c[c >= 0]] = 1
        own = np.sqrt(np.maximum(1, [len(b) for b in found])).astype(np.float32)
        return have @ self.landmarks / own[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernels([bins(t, 1, LONGEST) for t in texts]) @ self.weights + self.offset


def learn(rows: list[tuple[int, str, str]]) -> Model | None:
    """rows: (id, text, language), a bounded sample. None if there is nothing to learn from."""
    rows = [r for r in rows if has_letter(r[1])]
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    each = max(1, LANDMARKS // len(languages))
    chosen = [i for lang in languages for i in [j for j, r in enumerate(rows) if r[2] == lang][:each]][: max(LANDMARKS, len(languages))]
    found = {i: bins(rows[i][1], 1, LONGEST) for i in chosen}
    held = np.unique(np.concatenate(list(found.values())))
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[held] = np.arange(len(held), dtype=np.int32)
    matrix = np.zeros((len(held), len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen):
        matrix[column[found[i]], j] = 1 / np.sqrt(len(found[i]))
    model = Model(languages, column, matrix, np.zeros((len(chosen), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    kernel = model.kernels([found[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.concatenate([model.kernels([bins(r[1], 1, LONGEST) for r in rows[i : i + TEXTS_AT_ONCE]]) for i in range(0, len(rows), TEXTS_AT_ONCE)]).astype(np.float64) @ root
    targets = np.array([[1.0 if r[2] == lang else -1.0 for lang in languages] for r in rows])
    mean, offset = features.mean(axis=0), targets.mean(axis=0)
    centred = features - mean
    beta = np.linalg.solve(centred.T @ centred + RIDGE * len(rows) * np.eye(len(chosen)) / len(chosen), centred.T @ (targets - offset))
    model.weights = (root @ beta).astype(np.float32)
    model.offset = (offset - mean @ beta).astype(np.float32)
    return model


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame, held_out: tuple[int, int] | None = (3, 1)) -> Model | None:
    """Learn from docs (doc_id, text, lang): rows with a language, outside the held-out fold of their ids."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"))
    if held_out:
        rows = rows.filter(fold(F.col("doc_id"), held_out[0]) != held_out[1])
    try:
        return learn(sampled(docs, rows, "lang", PER_LANGUAGE, CHARACTERS, ROWS))
    finally:
        release()


def best(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; `und` and 0 without letters or model."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    judged = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    for i in range(0, len(judged), TEXTS_AT_ONCE):
        some = judged[i : i + TEXTS_AT_ONCE]
        s = model.scores([texts[j] for j in some]).astype(np.float64) * SHARPNESS
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for j, top, row in zip(some, p.argmax(axis=1).tolist(), p):
            lang[j], score[j] = model.languages[top], float(row[top])
    return lang, score


def known_share(model: Model, text: str) -> float:
    """The share of the text's n-grams that a landmark has too. Unlike a share among the languages it can be low for any
    number of them, one included."""
    return float((model.column[bins(text, 1, LONGEST)] >= 0).mean())


def kept(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs, all columns, that have a letter and whose known_share is `least` at least (any, if nothing was
    learnt)."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in map(pd.Series.tolist, batches):
            yield pd.Series([has_letter(t) and (shared.value is None or known_share(shared.value, t) >= least) for t in texts], dtype=bool)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(judged)(texts)

    return docs.filter(known(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def named(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """As kept, with the language found in place of docs' own column lang (which stays if nothing was learnt)."""
    rows = kept(docs, model, least)
    if model is None:
        return rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda batches: (pd.Series(best(shared.value, b.tolist())[0], dtype=object) for b in batches))(texts)

    said = found(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.select(*[said.alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row of docs (columns doc_id, text; others are ignored).

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learnt. The score
    is the share of the best language in the softmax of all scores. Repeated rows give repeated rows, equal texts
    equal values; an empty table gives none.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks and their n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = best(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
