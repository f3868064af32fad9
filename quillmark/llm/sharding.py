"""Sharding by a k-d tree over metadata.

A node that holds k leaves is split along its widest dimension (its range there, relative to the whole table's) at the
weighted median, or at k//2 : k - k//2 where k is odd, until each node is one leaf with its share of the bytes. Medians
are found for all nodes of a level at once, from histograms of bytes: each pass narrows every node's search to one of
FINE buckets; when a bucket has no more than FINE rows, these rows' coordinates decide. So what the driver sees of a
node is bounded by FINE entries.

The dimensions are metadata of the rows: source, language, number of characters. Rows of equal texts count with the
least metadata among them, so that a group of copies is one place.

Rows with the same value are cut further by a hash of their text, then of their id, and only if leaving them together
would miss the target by more than TOLERANCE of a leaf. So equal texts stay in one shard unless a group of copies that
lies across a boundary weighs more than that; then it is split, and a hot group never makes a shard too large.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, numbered

FINE, TOLERANCE, SCALE = 1024, 0.005, (1 << 31) - 1


@dataclass
class Node:
    leaves: int
    first: int  # leaf
    dim: int = -1
    at: tuple[int, ...] = ()  # rows whose coordinates (dimension, text, id, row) come before this go left


def before(coords: list[Column], at: tuple[int, ...]) -> Column:
    """The coordinates come before `at` in lexicographic order (`at` may be shorter)."""
    out = coords[len(at) - 1] < F.lit(at[-1])
    for c, x in reversed(list(zip(coords, at[:-1]))):
        out = (c < F.lit(x)) | ((c == F.lit(x)) & out)
    return out


def order(dim: int) -> list[Column]:
    return [F.col(f"_d{dim}"), F.col("_text"), F.col("_id"), F.col("_row")]


def descend(level: list[Node]) -> Column:
    """The child that a row goes to from the node it is in; nodes are known by their first leaf."""
    node = F.col("_node")
    return F.coalesce(*[F.when((node == n.first) & ~before(order(n.dim), n.at), F.lit(n.first + n.leaves // 2)) for n in level], node)


@dataclass
class Search:
    """For the weighted median of a node: what is before the interval, and the interval of the current coordinate."""

    node: Node
    target: float
    slack: float
    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = SCALE
    below: float = 0.0
    rows: int = 1 << 62  # in the interval

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // FINE))

    def inside(self) -> Column:
        """The node's rows in the interval."""
        coords, out = order(self.node.dim), F.col("_node") == self.node.first
        for c, x in zip(coords, self.prefix):
            out = out & (c == F.lit(x))
        return out & coords[len(self.prefix)].between(self.lo, self.hi)

    def bucket(self) -> Column:
        return F.when(self.inside(), F.floor((order(self.node.dim)[len(self.prefix)] - F.lit(self.lo)) / F.lit(self.step)).cast("long"))

    def decide(self, rows: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
        """Where to cut, from the coordinates and sizes of all rows in the interval: between different texts if that is
        near enough to the target, else nearest to it."""
        rows, done, apart, any_ = sorted(rows), self.below, [], []
        for i, (at, size) in enumerate(rows):
            any_.append((abs(done - self.target), i, at))
            if not i or rows[i - 1][0][:2] != at[:2]:
                apart.append(any_[-1])
            done += size
        end = (abs(done - self.target), len(rows), (*rows[-1][0][:3], rows[-1][0][3] + 1)) if rows else (0, 0, (*self.prefix, self.hi + 1))
        best = min([*apart, end])
        return best[2] if best[0] <= self.slack else min([*any_, end])[2]

    def narrow(self, sums: dict[int, int], counts: dict[int, int]) -> tuple[int, ...] | None:
        """The place to cut, or None if the search goes on in a smaller interval."""
        done = self.below
        for b in sorted(sums):
            after = done + sums[b]
            if after < self.target and after + self.slack < self.target:
                done = after
                continue
            start = self.lo + b * self.step
            if abs(done - self.target) <= self.slack and abs(done - self.target) <= abs(after - self.target):
                return (*self.prefix, start)
            if abs(after - self.target) <= self.slack:
                return (*self.prefix, start + self.step)
            self.below, self.rows = done, counts[b]
            if self.step > 1:
                self.lo, self.hi = start, min(self.hi, start + self.step - 1)
            elif len(self.prefix) == 3:
                return (*self.prefix, start + (after - self.target < self.target - done))
            else:  # one value weighs too much: cut among its rows by the next coordinate
                self.prefix, self.lo, self.hi = (*self.prefix, start), 0, (1 << 62) - 1
            return None
        return (*self.prefix, self.hi + 1)


def split(points: DataFrame, shards: int, dims: int) -> DataFrame:
    """points: _size, _d0.. (longs from 0 to SCALE), _text, _id, _row (longs from 0, below 2**62). Adds _node, the leaf."""
    level = [Node(shards, 0)]
    here = cut(points.withColumn("_node", F.lit(0)))
    while level := [n for n in level if n.leaves > 1]:
        stats = {r["_node"]: r for r in here.groupBy("_node").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"), *[f(f"_d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        searches = []
        for n in level:
            s = stats.get(n.first)
            if s is None:  # an empty node: any cut will do
                n.dim, n.at = 0, (0,)
                continue
            n.dim = max(range(dims), key=lambda i: (s[f"hi{i}"] - s[f"lo{i}"], -i))
            share = n.leaves // 2 / n.leaves
            searches.append(Search(n, s["bytes"] * share, TOLERANCE * s["bytes"] / n.leaves, lo=s[f"lo{n.dim}"], hi=s[f"hi{n.dim}"], rows=s["n"]))
        while searches:
            few, many = [s for s in searches if s.rows <= FINE], [s for s in searches if s.rows > FINE]
            if few:
                found: dict[int, list] = {s.node.first: [] for s in few}
                dim = F.coalesce(*[F.when(F.col("_node") == s.node.first, F.col(f"_d{s.node.dim}")) for s in few])
                inside = reduce(lambda a, b: a | b, [s.inside() for s in few])
                for r in here.filter(inside).select("_node", "_size", dim.alias("_d"), "_text", "_id", "_row").collect():
                    found[r["_node"]].append(((r["_d"], r["_text"], r["_id"], r["_row"]), r["_size"]))
                for s in few:
                    s.node.at = s.decide(found[s.node.first])
            searches = many
            if many:
                bucket = F.coalesce(*[s.bucket() for s in many])
                sums: dict[int, dict[int, int]] = {}
                counts: dict[int, dict[int, int]] = {}
                for r in here.select("_node", "_size", bucket.alias("_bucket")).filter("_bucket is not null").groupBy("_node", "_bucket").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).collect():
                    sums.setdefault(r["_node"], {})[r["_bucket"]] = r["bytes"]
                    counts.setdefault(r["_node"], {})[r["_bucket"]] = r["n"]
                searches = []
                for s in many:
                    at = s.narrow(sums.get(s.node.first, {}), counts.get(s.node.first, {}))
                    if at is None:
                        searches.append(s)
                    else:
                        s.node.at = at
        here = cut(here.withColumn("_node", descend(level)))  # one short step: nested choices grow beyond generated code
        level = [c for n in level for c in (Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2))]
    return here


def by_letters(c: Column) -> Column:
    """A string as a number that keeps the order of its first six bytes."""
    return F.conv(F.rpad(F.substring(F.hex(c.cast("string")), 1, 12), 12, "0"), 16, 10).cast("double")


def metadata(docs: DataFrame) -> dict[str, Column]:
    """The dimensions that the table has, of source, lang and n_chars; the logarithm of the text's bytes if it has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = {"source": by_letters(F.col("source")), "lang": by_letters(F.col("lang")), "n_chars": F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)) + 1)} if set(docs.columns) >= {"source", "lang", "n_chars"} else {}
    return known or {"bytes": F.log2(F.octet_length(text) + 8.0)}


def shard(docs: DataFrame, shards: int = 24, dims: dict[str, Column] | None = None) -> DataFrame:
    """Deal docs (columns doc_id, text and those that dims read) over shards 0 to shards - 1 of nearly equal bytes.

    dims: numeric metadata, by default `metadata`; a null counts as the least value. Returns doc_id, size (UTF-8 bytes of
    the text, null: none, plus 8), text_crc32, law (`bytes`), shard, slot (gapless from 0 in the shard, in order of hash
    buckets, then of doc_id), grown_shard (null). Repeated rows and rows without id are kept; an empty table gives no
    rows; shards may be empty if there are few rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dims = dims or metadata(docs)
    own = [f"_m{i}" for i in range(len(dims))]
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[c.cast("double").alias(m) for m, c in zip(own, dims.values())],
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("_text"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("_id"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = cut(raw)
    copies = cut(rows.groupBy("_text").agg(F.count("*").alias("_n"), *[F.min(m).alias(f"{m}g") for m in own]).filter("_n > 1"))
    rows = rows.join(copies, "_text", "left").withColumns({m: F.when(F.col("_n").isNull(), F.col(m)).otherwise(F.col(f"{m}g")) for m in own}).drop("_n", *[f"{m}g" for m in own])
    ends = rows.agg(F.count("*").alias("n"), *[f(m).alias(f"{n}{i}") for i, m in enumerate(own) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = lambda i: F.coalesce(((F.col(own[i]) - F.lit(ends[f"lo{i}"])) / F.lit((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0) * SCALE).cast("long"), F.lit(0).cast("long"))
    points = rows.withColumn("_size", F.col("size")).withColumns({f"_d{i}": scaled(i) if ends[f"lo{i}"] is not None else F.lit(0).cast("long") for i in range(len(dims))}).drop(*own)
    placed = split(points, shards, len(dims)).select("doc_id", "size", "text_crc32", "_row", F.col("_node").cast("int").alias("shard"))
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32", "_row"], "slot", ends["n"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
