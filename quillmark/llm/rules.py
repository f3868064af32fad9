"""Quality of texts by weak supervision: rules vote good, bad or abstain, and what a vote is worth is learnt without labels.

Each document is good or bad; given that, the rules vote independently of each other. Expectation-maximisation over the
counts of vote patterns of all documents estimates the share of good documents and of each rule how often it is right of
good and of bad ones when it votes. A document is kept if its posterior probability of being good is half or more, so
that one strict rule does not decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, ready, tidy
from quillmark.llm.words import filled, levels, pieces, split

# The symbols that count, and when the base rules fail.
SYMBOLS = "#*$%&|<>"
BASE_WORDS, BASE_REPEATED = 50, 50
WINDOW = 3
INF = float("inf")


@dataclass(frozen=True)
class Rule:
    """Votes good where low <= value <= high, bad where value is under least or over most, else abstains; so does null."""

    name: str
    value: str
    least: float
    low: float
    high: float
    most: float

    def vote(self) -> Column:
        v = F.expr(self.value)
        return F.when(v.isNull(), 0).when((v < self.least) | (v > self.most), 2).when(v.between(self.low, self.high), 1).otherwise(0)


#: Values are of the columns that `measured` gives; x / 0 is null.
RULES = [
    Rule("words", "n_words", 20, 50, INF, INF),
    Rule("word_length", "try_divide(word_chars, n_words)", 2, 3, 10, 14),
    Rule("symbols", "try_divide(n_symbols, n_words)", -INF, 0, 0.05, 0.25),
    Rule("repeated_lines", "if(n_lines > 1, n_dup_lines / n_lines, null)", -INF, 0, 0.1, 0.5),
    Rule("repeated_windows", "if(n_words > 2, n_repeat_words / n_words, null)", -INF, 0, 0.2, 0.4),
    Rule("most_frequent_word", "if(n_words >= 20, n_top_word / n_words, null)", -INF, 0, 0.12, 0.25),
    Rule("variety", "if(n_words >= 20, ln(n_different) / ln(n_words), null)", 0.55, 0.7, INF, INF),
    Rule("upper_case", "try_divide(n_upper, n_words)", -INF, 0, 0.15, 0.4),
    Rule("marks", "try_divide(n_marks, word_chars)", -INF, 0, 0.12, 0.25),
    Rule("repeated_marks", "try_divide(n_repeat_marks, n_words)", -INF, 0, 0.03, 0.2),
]
#: Rounds of the estimate and what it starts from: the share of good documents, and how often a vote on good ones and on bad
#: ones is right. Bad documents are bad in one way each, so most rules find them good; a start at over one half makes one
#: way all of the bad class. The start stays in the estimate with the weight of this share of all documents.
ROUNDS, GOOD, RIGHT, WEIGHT = 200, 0.8, (0.98, 0.3), 1e-2

_BLANK, _SYMBOL, _MARK = (np.array([chr(i) in of for i in range(256)]) for of in (" \t\n\x0b\x0c\r", SYMBOLS, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_top_word", "n_different", "n_upper", "n_marks", "n_repeat_marks"]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between bounds, for each neighbouring two."""
    found, real = np.zeros(len(bounds) - 1, dtype=np.int64), np.diff(bounds) > 0
    if real.any():
        found[real] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][real], dtype=np.int64)
    return found


def measures(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text (none is null)."""
    words, n = split(texts), len(texts)
    of, count = words.of, np.diff(words.bounds)
    top, different, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in levels(words.ids, of, WINDOW):
        if level.length == 1:
            text = of[level.pos[level.first]]
            np.maximum.at(top, text, level.sizes)
            different = np.bincount(text, minlength=n)
        elif level.length == WINDOW:
            edge = np.zeros(len(of) + WINDOW, np.int64)
            starts = level.pos[np.repeat(level.sizes > 1, level.sizes)]
            for k in range(WINDOW):
                edge[starts + k] = 1
            repeated = np.bincount(of[np.flatnonzero(edge[: len(of)])], minlength=n)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at -= at[0]
    parts = pc.split_pattern(texts, "\n")
    lines, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines))) > 0
    line_of = np.repeat(np.arange(n), np.diff(bounds))[real]
    n_lines = np.bincount(line_of, minlength=n)
    ids = np.asarray(lines.filter(pa.array(real)).dictionary_encode().indices, dtype=np.int64)
    unique = np.unique(line_of * (int(ids.max(initial=0)) + 1) + ids) // (int(ids.max(initial=0)) + 1)
    return [
        count, _sums((data & 0xC0 != 0x80) & ~_BLANK[data], at), _sums(_SYMBOL[data], at), n_lines - np.bincount(unique, minlength=n), repeated, n_lines, top, different,
        _sums(np.asarray(pc.utf8_is_upper(words.flat)), words.bounds), _sums(_MARK[data], at), np.asarray(pc.count_substring_regex(texts, r"!!|\?\?|\.\.\."), dtype=np.int64),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of each row of docs (doc_id, text; other columns are ignored); a null text counts as empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(m, pa.int64()) for m in measures(filled(piece.column(1))))], ["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ["doc_id", *MEASURES]))


@dataclass(frozen=True)
class Model:
    good: float  # share of good documents
    right: np.ndarray  # of each rule: how often its votes on good ones and on bad ones are right


def estimate(votes: np.ndarray, counts: np.ndarray) -> Model:
    """From the vote patterns (rows; columns: rules; 0 abstains, 1 good, 2 bad) and how many documents have each."""
    rules = votes.shape[1]
    good, right = GOOD, np.tile(RIGHT, (rules, 1)).astype(float)
    own = max(1.0, WEIGHT * counts.sum()) if len(counts) else 1.0
    for _ in range(ROUNDS if len(counts) else 0):
        p = posterior(votes, Model(good, right))
        before, good = good, (own * GOOD + counts @ p) / (own + counts.sum())
        for k, (share, vote) in enumerate(((p, 1), (1 - p, 2))):
            weight = counts * share
            right[:, k] = (own * RIGHT[k] + weight @ (votes == vote)) / (own + weight @ (votes > 0))
        if abs(good - before) < 1e-9:
            break
    return Model(float(good), right)


def weights(model: Model) -> np.ndarray:
    """Of each rule what a vote for good and one for bad add to the log odds of good."""
    g, b = np.clip(model.right, 1e-6, 1 - 1e-6).T
    return np.column_stack([np.log(g / (1 - b)), np.log((1 - g) / b)])


def posterior(votes: np.ndarray, model: Model) -> np.ndarray:
    w = weights(model)
    odds = np.log(model.good / (1 - model.good)) + (votes == 1) @ w[:, 0] + (votes == 2) @ w[:, 1]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(measures: DataFrame, rules: list[Rule] = RULES) -> Model:
    """Votes of all rows, counted by pattern; at most 3 ** rules patterns come to the driver."""
    seen = measures.groupBy(*[r.vote().alias(r.name) for r in rules]).count().collect()
    found = np.array([tuple(r) for r in seen], dtype=np.int64).reshape(-1, len(rules) + 1)
    return estimate(found[:, :-1], found[:, -1].astype(float))


def judged(measures: DataFrame, model: Model, rules: list[Rule] = RULES) -> DataFrame:
    """The rows with `posterior`, the probability of being good."""
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for rule, (good, bad) in zip(rules, weights(model).tolist()):
        odds = odds + F.when(rule.vote() == 1, good).when(rule.vote() == 2, bad).otherwise(0.0)
    return measures.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior of each row of docs.

    A null or empty text has no words and fails the base rules. Repeated rows give repeated rows, equal texts equal
    values; an empty table gives none.
    """
    own = cut(measured(docs))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    return judged(own, fit(own)).select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
