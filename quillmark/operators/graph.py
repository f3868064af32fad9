"""Bounded breadth-first search over call edges, one join per depth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import cut


@dataclass
class Traces:
    """Of each start: nodes (start_id, symbol_id, depth, queue_position), edges (start_id, relation_id, source_id,
    target_id, depth, kind: tree, cycle, known or over), unresolved (start_id, relation_id, source_id, target_ref, depth)
    and cut (start_id) where a cap has left something out."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    cut: DataFrame


@dataclass
class Trace:
    nodes: DataFrame  # symbol_id, depth, queue_position
    edges: DataFrame  # relation_id, source_id, target_id, depth, kind: tree, cycle, known or over
    unresolved: DataFrame  # relation_id, source_id, target_ref, depth
    truncated: bool


def traces(relations: DataFrame, starts: DataFrame, max_depth: int = 4, max_nodes: int = 80, max_edges: int = 1_000) -> Traces:
    """Breadth-first from every row of starts (start_id) over relations (relation_id, source_id, target_id or null,
    target_ref, confidence), all starts at once and each with its own caps.

    Nodes are expanded in order of arrival; a node's edges in order of confidence (high first), target_ref, id, the first
    max_edges of them. A target among the node's own ancestors is a cycle, a known one isn't expanded again, and above
    max_nodes no node is added. Each depth is one join of all frontiers with the edges: what the order decides inside it
    (the first edge to a new node, how many may still be added) are ranks over the start's edges of this depth, of which
    there are max_nodes * max_edges at most.
    """
    order = [F.desc("confidence"), F.col("target_ref"), F.col("relation_id")]
    ranked = relations.select("relation_id", "source_id", "target_id", "target_ref", "confidence").withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    ranked = cut(ranked.filter(F.col("nth") <= max_edges + 1).drop("confidence"))
    starts = starts.select("start_id").distinct()
    nodes = cut(starts.select("start_id", F.col("start_id").alias("symbol_id"), F.lit(0).alias("depth"), F.lit(0).alias("queue_position"), F.array("start_id").alias("path")))
    steps, have = [], nodes
    for depth in range(1, max_depth + 1):
        frontier = nodes.filter(F.col("depth") == depth - 1).select("start_id", F.col("symbol_id").alias("source_id"), "queue_position", "path")
        counts = nodes.groupBy("start_id").agg(F.count("*").alias("_have"))
        own = ranked.join(frontier, "source_id").join(counts, "start_id")
        known = nodes.select("start_id", F.col("symbol_id").alias("target_id"), F.lit(True).alias("_known"))
        own = own.join(known, ["start_id", "target_id"], "left").withColumn("_over_edges", F.col("nth") > max_edges)
        new = F.col("_known").isNull() & F.col("target_id").isNotNull() & ~F.col("_over_edges")
        at = F.struct("queue_position", "nth")
        first = F.min(F.when(new, at)).over(Window.partitionBy("start_id", "target_id"))
        own = own.withColumn("_new", new).withColumn("_first", new & (first == at))
        arrived = Window.partitionBy("start_id").orderBy("queue_position", "nth").rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumn("_rank", F.sum(F.col("_first").cast("long")).over(arrived))
        # all edges to one new node share the fate of the first
        rank = F.min(F.when(F.col("_first"), F.col("_rank"))).over(Window.partitionBy("start_id", "target_id"))
        own = own.withColumn("_fits", F.col("_have") + rank <= max_nodes)
        kind = (
            F.when(F.col("_over_edges"), "cut").when(F.col("target_id").isNull(), "unresolved").when(F.array_contains("path", F.col("target_id")), "cycle")
            .when(~F.col("_new"), "known").when(~F.col("_fits"), "over").when(F.col("_first"), "tree").otherwise("known")
        )
        step = cut(own.select("start_id", "relation_id", "source_id", "target_id", "target_ref", "path", F.lit(depth).alias("depth"), kind.alias("kind"), (F.col("_have") + F.col("_rank") - 1).cast("int").alias("queue_position")))
        steps.append(step)
        added = step.filter("kind = 'tree'").select("start_id", F.col("target_id").alias("symbol_id"), "depth", "queue_position", F.array_append("path", F.col("target_id")).alias("path"))
        if added.isEmpty():
            break
        have = have.unionByName(added)
        nodes = have
    taken = reduce(DataFrame.unionByName, steps)
    return Traces(
        have.drop("path"), taken.filter(F.col("kind").isin("tree", "cycle", "known", "over")).drop("path", "target_ref", "queue_position"),
        taken.filter("kind = 'unresolved'").select("start_id", "relation_id", "source_id", "target_ref", "depth"), taken.filter(F.col("kind").isin("cut", "over")).select("start_id").distinct(),
    )


def trace(relations: DataFrame, start: int, max_depth: int = 4, max_nodes: int = 80, max_edges: int = 1_000) -> Trace:
    """`traces` of one start."""
    found = traces(relations, relations.sparkSession.range(start, start + 1).withColumnRenamed("id", "start_id"), max_depth, max_nodes, max_edges)
    return Trace(found.nodes.drop("start_id"), found.edges.drop("start_id"), found.unresolved.drop("start_id"), not found.cut.isEmpty())


def reach(relations: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Nodes within max_depth of each start (start_id) and their least depth, without a cap on their number: the frontier
    stays distributed and loses at each depth what was reached before."""
    relations = cut(relations.select("source_id", "target_id").filter("target_id is not null").distinct())
    seen = cut(starts.select("start_id", F.col("start_id").alias("symbol_id"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = relations.join(frontier.select("start_id", F.col("symbol_id").alias("source_id")), "source_id").select("start_id", F.col("target_id").alias("symbol_id")).distinct()
        frontier = cut(step.join(seen, ["start_id", "symbol_id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def neighbours(relations: DataFrame, symbol: int, most: int = 20) -> DataFrame:
    """Out- and in-edges of a symbol, each side's most confident first."""
    out = relations.filter(F.col("source_id") == symbol).withColumn("side", F.lit("outgoing"))
    into = relations.filter(F.col("target_id") == symbol).withColumn("side", F.lit("incoming"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("confidence"), "target_ref", "relation_id"))
    return out.unionByName(into).withColumn("nth", rank).filter(F.col("nth") <= most)


def with_facts(nodes: DataFrame, facts: DataFrame, most: int = 8) -> DataFrame:
    """Nodes with their facts, in order of line and type, at most `most`."""
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy("source_line", "fact_type", "fact_id"))
    few = facts.withColumn("_n", rank).filter(F.col("_n") <= most).groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("source_line", "fact_type", "fact_id"))).alias("facts"))
    return nodes.join(few, "symbol_id", "left")
