"""Innermost intervals by a sweep, and traces of many starts, against plain loops."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import facts, graph, running, similar


@pytest.mark.parametrize("bucket", [65_536, 4])
def test_innermost_equals_a_loop(spark, monkeypatch, bucket):
    monkeypatch.setattr(running, "BUCKET_ROWS", bucket)
    r = random.Random(bucket)
    spans = [(r.choice(["a", "b", None]), k, s := r.randrange(300), s + r.choice([0, 1, 5, 40, 250])) for k in range(120)]
    spots = [(r.choice(["a", "b", "c", None]), 1000 + k, r.randrange(-5, 600)) for k in range(200)]
    got = {x["point_id"]: x["symbol_id"] for x in facts.innermost(spark.createDataFrame(spots, "path string, point_id long, line int"), spark.createDataFrame(spans, "path string, symbol_id long, start_line int, end_line int"), ["path"]).collect()}
    around = lambda path, line: min(((e - s, -s, k) for p, k, s, e in spans if p == path is not None and s <= line <= e), default=(0, 0, None))[2]
    assert got == {k: around(path, line) for path, k, line in spots}


def test_a_million_lines_are_one_row(spark):
    spans = spark.createDataFrame([("f", 1, 1, 1_000_000), ("f", 2, 10, 900_000), ("f", 3, 500, 500)], "path string, symbol_id long, start_line int, end_line int")
    spots = spark.createDataFrame([("f", k, line) for k, line in enumerate((1, 10, 500, 501, 900_001, 1_000_001))], "path string, point_id long, line int")
    assert {x["point_id"]: x["symbol_id"] for x in facts.innermost(spots, spans, ["path"]).collect()} == {0: 1, 1: 2, 2: 3, 3: 2, 4: 1, 5: None}


def plain_trace(edges, start, max_depth, max_nodes, max_edges):
    found, queue, out = {start: (0, 0)}, [(start, 0, [start])], []
    for node, depth, path in queue:
        own = sorted((e for e in edges if e[1] == node), key=lambda e: (-e[4], e[3], e[0]))
        for relation, _, target, _, _ in own[:max_edges] if depth < max_depth else []:
            kind = "unresolved" if target is None else "cycle" if target in path else "known" if target in found else "over" if len(found) >= max_nodes else "tree"
            out.append((start, relation, kind, depth + 1))
            if kind == "tree":
                found[target] = depth + 1, len(found)
                queue.append((target, depth + 1, [*path, target]))
    return {(start, n, *v) for n, v in found.items()}, set(out)


def test_traces_equal_a_queue(spark):
    r = random.Random(3)
    edges = [(k, r.randrange(30), r.choice([None, *range(30)]), r.choice("xyz"), r.choice([0.1, 0.5, 0.9])) for k in range(150)]
    relations = spark.createDataFrame(edges, "relation_id long, source_id long, target_id long, target_ref string, confidence double")
    found = graph.traces(relations, spark.range(12).withColumnRenamed("id", "start_id"), 4, 9, 4)
    nodes, steps = zip(*(plain_trace(edges, s, 4, 9, 4) for s in range(12)))
    assert {(x["start_id"], x["symbol_id"], x["depth"], x["queue_position"]) for x in found.nodes.collect()} == set().union(*nodes)
    lost = {(x["start_id"], x["relation_id"], "unresolved", x["depth"]) for x in found.unresolved.collect()}
    assert {(x["start_id"], x["relation_id"], x["kind"], x["depth"]) for x in found.edges.collect()} | lost == set().union(*steps)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_similar_texts_equal_all_pairs(spark, threshold):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 7)))
    make = lambda n, name: spark.createDataFrame([(k, r.choice([None, "", "same line", " ".join(word() for _ in range(r.randint(1, 3)))])) for k in range(n)], f"{name} int, content string")
    left, right = make(60, "left_id"), make(90, "right_id")
    grams = lambda df, c: df.select(df.columns[0], F.array_distinct(T.trigrams(F.col("content"))).alias(c)).filter(F.size(c) > 0)
    pairs = grams(left, "g").join(grams(right, "h"), F.lit(True)).withColumn("s", similar.jaccard(F.col("g"), F.col("h"))).filter(F.col("s") >= threshold)
    got = {(x["left_id"], x["right_id"]): x["similarity"] for x in similar.similar(left, right, threshold).collect()}
    assert got == {(x["left_id"], x["right_id"]): x["s"] for x in pairs.collect()} and got
    assert similar.similar(left.limit(0), right, threshold).count() == similar.similar(left, right.limit(0), threshold).count() == 0
