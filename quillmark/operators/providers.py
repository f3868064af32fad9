"""Model calls as functions over columns, with deterministic stand-ins that need no network.

A provider is any callable on a batch: texts to vectors, or (question, texts) to scores. The stand-ins hash words to
signed buckets, count shared words and answer from a script; a deployment passes its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import keyword_terms

Embedder = Callable[[list[str]], np.ndarray]
#: Prompts to answers. What a model is asked for (plans, next actions, grades, rewordings, tool calls) is JSON in the answer.
Completer = Callable[[list[str]], list[str]]


def hashed_vectors(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """Unit vectors of word counts in signed hash buckets; zero for texts without words."""
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dimensions] += 1 if h >> 31 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def embedded(text: Column, embedder: Embedder = hashed_vectors) -> Column:
    """array<float> of each text; the provider is set up once for a task and called on whole batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist()).astype(np.float32)))

    return embed(text)


def reranked(hits: DataFrame, question: str, top: int, score: Column | None = None) -> DataFrame:
    """hits (query_id, rank, chunk_id, content) in a new order by score (by default shared terms), `top` for each query;
    ties keep the order they had."""
    own = score if score is not None else F.size(F.array_intersect(keyword_terms(F.col("content")), keyword_terms(F.lit(question)))).cast("double")
    scored = hits.withColumn("rerank_score", own)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "chunk_id"))
    return scored.withColumn("new_rank", nth).filter(F.col("new_rank") <= top)


def lexical(content: Column, words: Column) -> Column:
    """How many of the words (lower case) a text has."""
    return F.size(F.array_intersect(F.transform(F.regexp_extract_all(content, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: F.lower(w)), words))


def scripted(script: list[tuple[str, str]], otherwise: str = "") -> Completer:
    """A completer that needs no model: the answer of the first pattern that a prompt matches."""
    rules = [(re.compile(p), a) for p, a in script]
    return lambda prompts: [next((a for p, a in rules if p.search(prompt)), otherwise) for prompt in prompts]


def completed(prompt: Column, completer: Completer) -> Column:
    """The answer to each prompt, asked for in whole batches; a null prompt has none."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = pd.Series([None] * len(prompts), dtype=object)
            asked = prompts.notna().to_numpy()
            out[asked] = completer(prompts[asked].tolist())
            yield out

    return ask(prompt)


def asked_for(task: str, **parts: Column) -> Column:
    """A prompt: the task, then its parts by name as JSON."""
    return F.concat(F.lit(f"{task}\n"), F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])))


def tool_calls(answer: Column) -> Column:
    """The tools that an answer calls: array<struct<id, name, arguments>>; empty if it calls none."""
    schema = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
    return F.coalesce(F.from_json(answer, schema)["tool_calls"], F.array().cast("array<struct<id: string, name: string, arguments: string>>"))


def streamed(answers: DataFrame, key: str, answer: str, size: int = 40) -> DataFrame:
    """An answer as the pieces in which it would be sent: key, seq, delta; put together they are the answer."""
    n = F.ceil(F.length(answer) / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(answer), i * size + 1, F.lit(size)))
    return answers.filter(F.length(answer) > 0).select(key, F.posexplode(pieces).alias("seq", "delta"))


def graded(grades: Column) -> Column:
    """A grader's answer: struct<sufficient boolean, reason, missing array<string>>; an answer that can't be read is not
    sufficient."""
    schema = "struct<sufficient: boolean, reason: string, missing: array<string>>"
    d = F.from_json(grades, schema)
    return F.struct(F.coalesce(d["sufficient"], F.lit(False)).alias("sufficient"), F.substring(F.coalesce(d["reason"], F.lit("")), 1, 500).alias("reason"), F.slice(F.coalesce(d["missing"], F.array().cast("array<string>")), 1, 10).alias("missing"))
