"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, unshuffled


def _to_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): the least v of each u, beside every v. The aggregate combines before its shuffle; a hub's rows meet
    one row of it in a join, which the adaptive planner splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type, in any direction, repeated or not; nulls and loops are ignored.

    Returns (node, root) for every node of an edge that isn't a loop: root is the component's least node. Each round
    is written to the checkpoint folder; the edges never leave the executors.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e), None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_least(large)
        stars = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = cut(stars.filter("a <> b").distinct())
        del both, large, small, stars
        unshuffled(e.sparkSession)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
