"""SimHash near-duplicates by pivot distance tables.

A fingerprint's bits are the majority of its shingles' hashes. The pivot table is computed once for the different
fingerprints: columns with each one's Hamming distances to PIVOTS fixed reference fingerprints, which go with it wherever
it is compared. By the triangle inequality two fingerprints within the radius differ by no more than the radius in any
coordinate, so a larger difference discards the pair, and what survives is verified by its distance.

A pivot table alone gives no key to deal pairs by: each coordinate has some ten likely values, so cells of pivot
distances grow slower than the copies that their borders need. So pairs are first brought together by agreement: of
radius + 2 slices of the bits two at least agree. Groups above LARGEST are dealt anew by further agreeing bits (of
radius + 1 parts of those that may still differ, one at least agrees), until they are small or so few bits are left that
the number of different fingerprints is bounded. No pair is lost, no group is expanded into all its pairs: a group, in
order of the first pivot's distances, yields the edges of a spanning forest. What is still large then is compared part by
part, in memory that LARGEST bounds.

Texts that are alike in their shingles but less so in 64 bits are found by `near_copies`: several such fingerprints with
a larger radius give the candidates, exact Jaccard similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, cut, ready, tidy, unshuffled
from quillmark.llm.components import components
from quillmark.llm.substrings import THRESHOLD, document_shingles, in_cells, mixed, verified, whole_hashes, word_hashes

BITS, SEED = 64, 42
#: Fingerprints of a group that one task compares; rows compared at a time; bits below which a group is no longer dealt anew.
LARGEST, ROWS_AT_ONCE, FEW_BITS = 4096, 256, 16
#: Times that large groups are dealt anew at most.
DEPTH = 3
PIVOTS = 16
#: Rows (24 bytes at most) of a list that is sent to every executor at most; a larger one is joined.
LISTED = 2_000_000
#: Groups up to this size are compared many at a time.
SMALL = 32
#: Of the candidates of near_copies: fingerprints of a text, radius. Of texts with words changed, left out and put in until
#: their five-word shingles had similarity 0.8, one fingerprint met half or more, so that one of six meets 98 to 99.5 %. A
#: larger radius with fewer fingerprints would leave keys of fewer bits, whose groups grow with the table.
SKETCHES, SKETCH_RADIUS = 6, 3


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text; 0 if it has no words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(tokens)) - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 65_536].tolist(), ends[i : i + 65_536].tolist())], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key of the text and fp (the fingerprint as a signed long) of each row of docs (columns doc_id, text)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, key long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, drawn once from a seeded generator."""
    return np.random.default_rng(20_240_229).integers(0, 1 << 64, n, dtype=np.uint64)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of linked pairs: label[i] becomes the least member of i's component."""
    while len(a):
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label[:] = label[label]


def survivors(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no coordinate of the pivot table discards and that are within the radius."""
    for p in range(table.shape[1]):
        keep = np.abs(table[a, p] - table[b, p]) <= radius
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[keep], b[keep]


def partners(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row of `first` with the n rows after it."""
    a = np.repeat(first, n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a + 1


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps (fp, ...) with its pivot distances, eight to each of the columns p0, p1, ... (a byte each)."""
    each = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(p))))).cast("long") for p in pivots()]
    return fps.withColumns({f"p{i}": reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 8 * j) for j, d in enumerate(each[8 * i : 8 * i + 8])]) for i in range(PIVOTS // 8)})


def near(fps: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """For different fingerprints (uint64) with their rows of the pivot table: the index of the least member of each one's
    component at this radius."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    stops = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    label = np.arange(len(fps))
    for i in range(0, len(fps), ROWS_AT_ONCE):
        rows = np.arange(i, min(i + ROWS_AT_ONCE, len(fps)))
        joined(label, *survivors(fps, table, *partners(rows, stops[rows] - rows - 1), radius))
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[label]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def slices(free: list[int], n: int) -> list[int]:
    """Masks of n parts of the bit positions, as even as can be."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), n)]


def first_tables(radius: int) -> list[int]:
    """Masks of agreeing bits, such that fingerprints within the radius agree under one of them at least."""
    return [a | b for a, b in combinations(slices(list(range(BITS)), radius + 2), 2)]


def next_tables(mask: int, radius: int) -> list[int]:
    return [mask | s for s in slices([b for b in range(BITS) if not mask >> b & 1], radius + 1) if s]


def first_keyed(fps: DataFrame, radius: int) -> DataFrame:
    """fps (fp, ...) under each of the first masks: with the mask t and the bits under it, k."""
    masks = [F.lit(signed(m)).cast("long") for m in first_tables(radius)]
    entries = F.array(*[F.struct(m.alias("t"), F.col("fp").bitwiseAND(m).alias("k")) for m in masks])
    return fps.withColumn("e", F.explode(entries)).select(*fps.columns, "e.t", "e.k")


def keyed(rows: DataFrame, tables: dict[int, list[int]]) -> DataFrame:
    """rows (fp, t, ...) under the masks that follow from mask t: with the new t and k. The masks are a table of a size
    that the radius and the depth bound, joined by t, so the plan does not grow with them."""
    pairs = rows.sparkSession.createDataFrame([(signed(t), signed(m)) for t, masks in tables.items() for m in masks], "t long, m long")
    return rows.join(F.broadcast(pairs), "t").drop("t").withColumnRenamed("m", "t").withColumn("k", F.col("fp").bitwiseAND(F.col("t")))


def forest(groups: DataFrame, radius: int) -> DataFrame:
    """groups (s, members array<struct<fp, p0, p1>>): edges (s, a, b) of a spanning forest of each group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            own = slice(offsets[0], offsets[-1])
            fields = [lists.values.field(i).to_numpy()[own] for i in range(lists.type.value_type.num_fields)]
            flat, offsets = fields[0].view(np.uint64), offsets - offsets[0]
            table = np.stack(fields[1:], axis=1).view(np.int8)
            sizes, label = np.diff(offsets), np.arange(len(flat))
            # small groups all at once: each member with those after it
            end = np.repeat(np.where(sizes <= SMALL, offsets[1:], offsets[:-1]), sizes)
            rows = np.flatnonzero(end > label + 1)
            for i in range(0, len(rows), 65_536):
                some = rows[i : i + 65_536]
                joined(label, *survivors(flat, table, *partners(some, end[some] - some - 1), radius))
            for at, n in zip(offsets[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                label[at : at + n] = at + near(flat[at : at + n], table[at : at + n], radius)
            moved = np.flatnonzero(label != np.arange(len(flat)))
            s = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(s[moved], pa.int32()), *(pa.array(flat[c].view(np.int64)) for c in (moved, label[moved]))], ["s", "a", "b"])

    return groups.select("s", "members").mapInArrow(tidy(run), "s int, a long, b long")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps (fp long, all different, or of each s int if there is one): edges (a, b) whose components are those of all
    pairs within the radius, with their s, 0 without one."""
    fps = pivot_table(fps if "s" in fps.columns else fps.withColumn("s", F.lit(0)))
    dealt, out = first_keyed(fps, radius), None
    for depth in range(DEPTH + 1):
        # one number for s, t and k: should two of them share it, what they bring together is compared in vain
        rows = dealt.withColumn("key", F.xxhash64("s", "t", "k")).drop("k")
        counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        found_keys = counts.agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
        meeting = rows.join(F.broadcast(counts) if found_keys["keys"] <= LISTED else counts, "key")
        deal = depth < DEPTH and (found_keys["most"] or 0) > LARGEST
        again = (F.col("n") > LARGEST) & (F.bit_count("t") < BITS - FEW_BITS) if deal else F.lit(False)
        masks = [r["t"] % (1 << 64) for r in meeting.filter(again).select("t").distinct().collect()] if deal else []  # as many as there are masks at most
        # what is still large is compared in cells of two parts each
        parts = F.ceil(F.col("n") * 2 / LARGEST).cast("int")
        own = F.pmod(F.hash("fp"), parts)
        cells = F.when(F.col("n") <= LARGEST, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
        members = F.collect_list(F.struct("fp", *[f"p{i}" for i in range(PIVOTS // 8)])).alias("members")
        groups = meeting.filter(~again).select(*fps.columns, "key", F.explode(cells).alias("cell")).groupBy("s", "key", "cell").agg(members)
        found = cut(forest(groups.filter(F.size("members") > 1), radius).distinct())
        out = found if out is None else out.union(found)
        if not masks:
            break
        del groups
        unshuffled(fps.sparkSession)
        dealt = cut(keyed(meeting.filter(again).drop("key", "n"), {m: next_tables(m, radius) for m in masks}).distinct())
    return out


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def components_of(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """doc_id, key of the text, fp, root (the component's) and component_id of each row of docs."""
    rows = cut(fingerprints(docs, words))
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(own.select("fp"), radius))
    rooted = own.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of docs (columns doc_id, text; others are ignored): doc_id, fingerprint (16 lowercase hex
    digits), component_id, the least doc_id that links reach, its own included.

    Equal fingerprints are linked, those of texts without words too (zero). A null text counts as empty. Rows without
    doc_id get a fingerprint and their component's id, which is null if no member has one. Repeated rows give repeated
    rows; an empty table gives none.
    """
    return components_of(docs, words, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(words: np.ndarray) -> list[int]:
    """SKETCHES fingerprints of a text's words (hashes): signs of the votes of its different words, each with the root of
    its count, so that the words all texts share decide little and a changed word moves few bits."""
    different, n = np.unique(words, return_counts=True)
    weight, out = np.sqrt(n), []
    for seed in range(SKETCHES):
        h, votes = mixed(different ^ np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), np.zeros(BITS)
        for i in range(0, len(h), 65_536):
            bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += weight[i : i + 65_536] @ bits
        out.append(int(np.packbits(2 * votes > weight.sum(), bitorder="little").view("<u8")[0]))
    return out


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key of the text, root (one for each component) and component_id, the least id that links reach, of each row
    of docs (columns doc_id, text; others are ignored) with an id. Linked are texts whose sets of five-word shingles have
    this exact Jaccard similarity at least.

    Candidates are the texts that some fingerprint's links join, directly or not; all of such a component are compared.
    Texts of equal words are one text; those without words are linked with each other. Rows of one id may have texts in
    several components. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    names = ["doc_id", "key", "hash", *(f"f{i}" for i in range(SKETCHES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words, counts = word_hashes(text)
                shingles, starts = document_shingles(words, counts)[2:]
                rows.append([int(whole_hashes(shingles, starts)[0]) if len(starts) else 0, *sketches(words)])
            cols = np.array(rows, dtype=np.uint64).reshape(-1, 1 + SKETCHES).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in cols.T)], names)

    with Scratch(docs.sparkSession) as written:
        rows = written(own.select("doc_id", text_key().alias("key"), "text").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names)))
        texts = written(rows.groupBy("hash").agg(F.min("doc_id").alias("owner"), *[F.min(f"f{i}").alias(f"f{i}") for i in range(SKETCHES)]))
        sketched = texts.filter("hash <> 0").select("hash", F.posexplode(F.array(*[f"f{i}" for i in range(SKETCHES)])).alias("s", "fp"))
        counts = cut(sketched.groupBy("s", "fp").agg(F.count("*").alias("n")))
        edges = links(counts.select("s", "fp"), SKETCH_RADIUS)
        # of fingerprints and texts: a fingerprint's node is told apart by its s
        node = lambda c: F.xxhash64("s", c)
        joining = edges.select("s", F.col("a").alias("fp")).union(edges.select("s", F.col("b").alias("fp"))).union(counts.filter("n > 1").select("s", "fp")).distinct()
        bound = sketched.join(joining, ["s", "fp"]).select(F.col("hash").alias("a"), node("fp").alias("b"))
        unshuffled(docs.sparkSession)
        nodes = components(edges.select(node("a").alias("a"), node("b").alias("b")).union(bound))
        members = texts.select("hash").join(nodes.withColumnRenamed("node", "hash"), "hash")
        groups = in_cells(members.join(members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "root"), ["root"])
        unshuffled(docs.sparkSession)
        alike = components(verified(own, groups, texts, threshold, document_shingles))
        rooted = texts.select("hash", "owner").join(alike.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
        ids = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
        of = rooted.select("hash", "root").join(ids, "root")
        return cut(rows.select("doc_id", "key", "hash").join(of, "hash").select("doc_id", "key", "root", "component_id"))


def kept(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs, all columns, without the near duplicates, as first_of_each leaves them."""
    return first_of_each(docs, components_of(docs, words, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component in found (doc_id, key of the text, root) the row of docs with the least doc_id, of several texts
    of that id the one with the least key, and of equal rows of both one. Rows without id can't be named, so all of them
    stay. Each text of an id is judged by itself."""
    rows = found.filter("doc_id is not null").select("doc_id", "key", "root").distinct()
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("f"))
    gone = cut(rows.join(first, "root").filter((F.col("doc_id") != F.col("f.doc_id")) | (F.col("key") != F.col("f.key"))).select(F.col("doc_id").alias("_of"), F.col("key").alias("_gone")))
    own = docs.withColumn("_key", text_key())
    same = lambda other: (F.col("doc_id").cast("long") == F.col("_of")) & (F.col("_key") == F.col(other))
    small = lambda df: F.broadcast(df) if df.count() <= LISTED else df
    rest = own.join(small(gone), same("_gone"), "left_anti")
    repeated = cut(rest.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_of"), F.col("_key").alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    once = rest.join(small(repeated), same("_again"), "left_anti")
    again = rest.join(small(repeated), same("_again"), "left_semi").dropDuplicates(["doc_id", "_key"])
    return once.unionByName(again).select(*docs.columns)
