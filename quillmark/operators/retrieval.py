"""Recall, fusion, diversity and expansion to context under a budget. Ids and scores travel; text is joined last."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import TRIGRAM_THRESHOLD, cosine, keyword_terms, may_have_few_trigrams, token_estimate, trigrams
from quillmark.session import spread

RRF_K, PER_DOCUMENT = 60, 3
#: Queries that are sent to the executors at a time.
QUERY_BLOCK = 4_096
#: Scores of a batch of vectors with queries that a worker holds at a time (8 bytes each).
SCORES_AT_ONCE = 1 << 20


def visible(user: str | None, department: str | None) -> Column:
    """Workspace rows for all, personal ones for their owner, department ones for its members; null sees only the first."""
    return (F.col("scope_type") == "workspace") | ((F.col("scope_type") == "personal") & (F.col("owner_user_id") == F.lit(user))) | ((F.col("scope_type") == "department") & (F.col("owner_department_id") == F.lit(department)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest by cosine: the k best, ties by key; filters below this keep being filters before the limit."""
    return vectors.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """For each of the queries (query_id, q) the k best by cosine of vectors (vec_id, embedding): query_id, vec_id, score,
    rank, ties by vec_id. Vectors without length, and of another length than the query, have no score.

    Queries are handled `block` at a time, which bounds what is sent to the executors. There a batch of vectors meets the
    block in matrix products of bounded size, and only a batch's k best of each query leave it. The scan is repeated for each block.
    """
    rows = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    n = rows.count()
    parts = max(1, -(-n // block))
    found = None
    for i in range(parts):
        some = sorted((r["query_id"], r["q"]) for r in rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect() if r["q"] and all(x is not None for x in r["q"]))
        best = _best_of_batches(vectors, some, k)
        found = best if found is None else found.union(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best_of_batches(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    by_size: dict[int, tuple[list[int], np.ndarray]] = {}
    for size in {len(q) for _, q in queries}:
        own = [(i, q) for i, q in queries if len(q) == size]
        m = np.array([q for _, q in own], dtype=np.float64)
        length = np.sqrt((m * m).sum(axis=1))
        by_size[size] = [i for (i, _), x in zip(own, length) if x > 0], m[length > 0] / length[length > 0, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for size, (names, m) in by_size.items():
                rows = np.flatnonzero(known & (sizes == size))
                if not len(rows) or not len(names):
                    continue
                v = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                length = np.sqrt((v * v).sum(axis=1))
                rows, v = rows[length > 0], v[length > 0] / length[length > 0, None]
                own = ids[rows]
                step = max(1, SCORES_AT_ONCE // max(1, len(v)))
                for at in range(0, len(names), step):
                    for name, s in zip(names[at : at + step], m[at : at + step] @ v.T):
                        top = np.lexsort((own, -s))[:k] if len(s) <= 4 * k else _top(s, own, k)
                        out.append((np.full(len(top), name, np.int64), own[top], s[top]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, vec_id long, score double")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties by id: those that reach the k-th score, sorted."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def keyword_recall(chunks: DataFrame, terms: list[str], k: int, key: str = "doc_id", content: str = "content") -> DataFrame:
    """The k chunks most like any of the terms by trigrams, among those at the threshold for one.

    The terms are few literals: their trigrams are made once. A chunk with so many trigrams that no term can be a large enough
    part of them goes first, by its start if it is long; of the others' trigrams only those that some term has are looked at."""
    if not terms:
        return chunks.select(key, F.lit(None).cast("double").alias("keyword_score")).limit(0)
    made = chunks.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, terms)), trigrams)).first()[0]
    lit = lambda grams: F.array(*map(F.lit, sorted(grams))) if grams else F.array().cast("array<string>")
    most = math.floor(max(len(t) for t in made) / TRIGRAM_THRESHOLD + 1e-9)
    dealt = spread(chunks.select(key, F.col(content).alias("_c")), key)
    # made once, after the chunks are dealt: a filter would be tried before that, and what it asks for made again
    own = dealt.select(key, F.explode(F.when(may_have_few_trigrams(F.col("_c"), most), F.array(trigrams(F.col("_c"))))).alias("_g")).filter(F.size("_g").between(1, most))
    rows = own.select(key, F.size("_g").alias("_n"), F.explode(F.array(F.array_intersect("_g", lit({g for t in made for g in t})))).alias("_t")).filter(F.size("_t") > 0)
    shared = [F.size(F.array_intersect("_t", lit(set(t)))) for t in made]
    best = F.greatest(*[s / (F.col("_n") + F.lit(len(set(t))) - s) for s, t in zip(shared, made)], F.lit(0.0))
    scored = rows.select(key, best.alias("keyword_score")).filter(F.col("keyword_score") >= TRIGRAM_THRESHOLD)
    return scored.orderBy(F.desc("keyword_score"), key).limit(k)


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank): key, fused_score."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))).alias("fused_score"))


def diversify(fused: DataFrame, document: str, key: str, k: int, most: int = PER_DOCUMENT) -> DataFrame:
    """The k best with at most `most` of one document, in order of score, then key."""
    nth = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("fused_score"), key))
    return fused.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth").orderBy(F.desc("fused_score"), key).limit(k)


def expand(hits: DataFrame, parents: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """Hits (group, rank, chunk_id, parent_chunk_id, content) to context under a token budget.

    The first hit of a parent (or of a child without one) counts. The parent's text is taken if it fits, else the
    child's, else as much of the child's as fits; nothing follows once the budget is used. The fold runs over a
    query's ranked hits, a list as short as its top k.
    Returns group, rank, chunk_id, context_level, content, context_tokens.
    """
    joined = hits.join(parents.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content")), "parent_chunk_id", "left")
    whole = F.col("parent_content").isNotNull()
    seen = F.when(whole, F.concat(F.lit("p"), F.col("parent_chunk_id").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    first = joined.withColumn("_nth", F.row_number().over(Window.partitionBy(group, seen).orderBy("rank"))).filter("_nth = 1")
    text = F.coalesce("parent_content", "content")
    item = F.struct("rank", "chunk_id", whole.alias("whole"), text.alias("text"), F.col("content").alias("child"), token_estimate(text).alias("n"), token_estimate(F.col("content")).alias("c"))
    lists = first.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("hits"))
    out = "array<struct<rank: bigint, chunk_id: bigint, context_level: string, content: string, context_tokens: bigint>>"

    def step(acc: Column, hit: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        cut = F.substring(hit["child"], F.lit(1), F.greatest(F.lit(2).cast("long"), left * 2).cast("int"))
        level = F.when(hit["n"] <= left, F.when(hit["whole"], "parent").otherwise("child")).when(hit["c"] <= left, "child_fallback").otherwise("child_truncated")
        content = F.when(hit["n"] <= left, hit["text"]).when(hit["c"] <= left, hit["child"]).otherwise(cut)
        tokens = F.when(hit["n"] <= left, hit["n"]).when(hit["c"] <= left, hit["c"]).otherwise(token_estimate(cut))
        row = F.struct(hit["rank"].cast("long").alias("rank"), hit["chunk_id"].cast("long").alias("chunk_id"), level.alias("context_level"), content.alias("content"), tokens.alias("context_tokens"))
        return F.when(left <= 0, acc).otherwise(F.struct((acc["used"] + tokens).alias("used"), F.concat(acc["rows"], F.array(row)).alias("rows")))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(out).alias("rows"))
    return lists.select(group, F.inline(F.aggregate("hits", start, step, lambda acc: acc["rows"])))


def rewrites(question: Column) -> Column:
    """Other wordings to try: the words of more than one character, first twelve, all but last, all but first, last eight."""
    words = F.filter(F.split(F.trim(F.regexp_replace(question, r"(?U)[^\w\s]+", " ")), r"\s+"), lambda w: F.length(w) > 1)
    n = F.size(words)
    take = lambda a, m: F.array_join(F.slice(words, a, m), " ")
    tries = F.array(take(1, 12), take(F.lit(1), F.greatest(n - 1, F.lit(0))), take(F.lit(2), F.greatest(n - 1, F.lit(0))), take(F.greatest(n - 7, F.lit(1)), F.lit(8)))
    return F.array_distinct(F.filter(tries, lambda t: (t != "") & (F.lower(t) != F.lower(question))))


__all__ = ["diversify", "expand", "fuse", "keyword_recall", "keyword_terms", "nearest", "nearest_each", "rewrites", "visible"]
