"""Substring dedup: paragraphs that repeat, by MinHash banding, and passages that repeat inside them.

Paragraphs are the lines that have a shingle, so SHINGLE words at least. Their five-word shingles give MinHash
signatures; the number of bands is the least that reaches the wanted recall at the threshold. Different paragraphs that
collide in a band are compared by their exact Jaccard similarity and linked from the threshold on; the components of
links decide which to remove. A passage that is wrapped otherwise, with a word changed, leaves no line alike: so lines
of less than BLOCK_WORDS words are compared as blocks of neighbours too, with each other and with the lines. A block
goes if it is linked directly with a document of a lesser id.

A passage inside longer lines makes no two of them alike. So windows of WINDOW words are compared too: of every STRIDE
windows in a row the one with the least hash is taken, so documents that share WINDOW + STRIDE - 1 words in a row share
a window. Around the shared ones all windows are compared, so a shared run is met up to its ends.

Of a component or window that occurs in several documents, the occurrences in the one with the least id stay. The
others are repeats; of these, runs of at least `least` words are removed, the shorter ones (a license line, a caption)
are told apart from them. Everything that is shuffled is a hash with an id; texts are read where they lie, beside lists
of repeats of a checked size (a larger list is joined by id).

A row is known by its id and a hash of its text, so rows of one id may have different texts. They count as one document:
what they share with each other stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, cut, tidy, unshuffled
from quillmark.llm.components import components

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.995, 3
BLOCK_WORDS, WINDOW, STRIDE = 50, 24, 16
#: Words in a row that repeat from which on they are removed: shorter ones are no window either.
LEAST = WINDOW
#: Paragraphs of a band's group that are compared in one task; entries (16 bytes) of a list that is sent to every executor at most.
LARGEST, LISTED = 1024, 2_000_000
#: Words whose paragraphs get their signatures together.
WORDS_AT_ONCE = 200_000
#: Told apart by this: the hashes of blocks from those of lines. Sets up to this many are compared pair by pair.
BLOCK, FEW = np.uint64(0x5851F42D4C957F2D), 32
WORD = re.compile(rb"[^\x09-\x0d\x20]+")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of `rows` hashes with which a pair at the threshold collides with this probability."""
    n = 1
    while 1 - (1 - threshold**rows) ** n < recall:
        n += 1
    return n


BANDS = bands_for()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MULTIPLY
    return h ^ h >> np.uint64(29)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = h * np.uint64(0x100000001B3) + words[i : len(words) - n + 1 + i]
    return mixed(h)


def slide(h: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over every n values in a row."""
    size, out = 1, h
    while 2 * size <= n:
        out = least(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def chosen(h: np.ndarray) -> np.ndarray:
    """Positions of the windows taken: those that have the least hash of some STRIDE windows in a row."""
    if len(h) <= STRIDE:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = slide(h, STRIDE, np.minimum)
    pad = np.zeros(STRIDE - 1, dtype=h.dtype)
    return np.flatnonzero(slide(np.concatenate([pad, low, pad]), STRIDE, np.maximum) == h)


def tag_of(text: str | None) -> int:
    """31 bits that tell the texts of one id apart."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) & 0x7FFFFFFF


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the number of words of each line."""
    digest, hashes, counts = xxhash.xxh3_64_intdigest, [], []
    for line in (text or "").encode().lower().split(b"\n"):
        words = line.split()
        counts.append(len(words))
        hashes.extend(map(digest, words))
    return np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)


@lru_cache(maxsize=1)
def permutations() -> list[tuple[np.uint64, np.uint64]]:
    seeds = np.random.default_rng(11).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
    return [(m, a) for m, a in seeds]


def signature(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
    """Band values (paragraphs x BANDS) of shingle hashes that begin at starts for each paragraph, and end at stops if
    these are given: they may overlap then."""
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    every = 1 if stops is None else 2
    if stops is not None:
        shingles, starts = np.append(shingles, np.uint64(0)), np.column_stack([starts, stops]).ravel()
    for i, (m, a) in enumerate(permutations()):
        own = shingles * m
        own += a
        own >>= np.uint64(16)
        out[:, i // ROWS] = out[:, i // ROWS] * np.uint64(0x100000001B3) + np.minimum.reduceat(own, starts)[::every]
    return mixed(out ^ np.arange(BANDS, dtype=np.uint64) * MULTIPLY)  # bands tell themselves apart


def whole_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's shingles in their order."""
    sizes = np.diff(np.append(starts, len(shingles)))
    nth = np.arange(len(shingles), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(shingles + nth), starts))


def paragraph_shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that have a shingle: first words, numbers of words, all their shingles, and where each one's
    shingles begin."""
    ends = np.cumsum(counts)
    own = np.flatnonzero(counts >= SHINGLE)
    first, n = (ends - counts)[own], counts[own]
    if not len(own):
        return first, n, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_ = runs(words, SHINGLE)
    sizes = n - SHINGLE + 1
    starts = np.cumsum(sizes) - sizes
    return first, n, all_[np.repeat(first - starts, sizes) + np.arange(sizes.sum())], starts


def line_blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of neighbouring short lines: first words and numbers of words. From each short line on, the fewest lines
    that have BLOCK_WORDS words; they overlap. No block holds a line of BLOCK_WORDS words."""
    counts = counts[counts > 0]
    to, long = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts >= BLOCK_WORDS))
    ends = np.searchsorted(to, to[:-1] + BLOCK_WORDS)
    begins = np.flatnonzero(ends <= len(counts))
    begins = begins[long[ends[begins]] == long[begins]]
    return to[begins], to[ends[begins]] - to[begins]


def gathered(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ranges one after the other, and where each one's begin."""
    starts = np.cumsum(sizes) - sizes
    return np.repeat(first - starts, sizes) + np.arange(sizes.sum()), starts


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that have a shingle, then of the blocks: first words, numbers of words, what their hashes are marked with."""
    ends, own = np.cumsum(counts), np.flatnonzero(counts >= SHINGLE)
    begin, size = line_blocks(counts)
    return np.append((ends - counts)[own], begin), np.append(counts[own], size), np.repeat(np.array([0, BLOCK], np.uint64), [len(own), len(begin)])


def unit_shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines and blocks: as paragraph_shingles, and what their hashes are marked with."""
    first, n, mark = units_of(counts)
    if not len(first):
        return first, n, np.zeros(0, np.uint64), np.zeros(0, np.int64), mark
    at, starts = gathered(first, n - SHINGLE + 1)
    return first, n, runs(words, SHINGLE)[at], starts, mark


def document_shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The whole text as one unit, as paragraph_shingles gives them; fewer words than SHINGLE are one shingle, none are
    no unit."""
    none, n = np.zeros(0, np.int64), len(words)
    return (np.array([0]), np.array([n]), runs(words, min(SHINGLE, n)), np.array([0])) if n else (none, none, np.zeros(0, np.uint64), none)


def parts(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id not null, text) taken apart: kind 0 the document (size words), 1 its lines (at, size, hash,
    bands b0..), 2 its windows (at, hash), 3 its blocks of short lines (as lines). at is the text's tag, then the first
    word in the low 32 bits."""
    names = ["kind", "doc_id", "at", "size", "hash", *(f"b{i}" for i in range(BANDS))]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        """held: id, tag, shingles, units, number of words, positions and hashes of windows."""
        ids, tags = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64) << 32
        offsets = np.cumsum([0, *(len(h[2]) for h in held[:-1])])
        shingles = np.concatenate([h[2] for h in held])
        first, size, mark = (np.concatenate([h[3][i] for h in held]) for i in range(3))
        units, windows = [len(h[3][0]) for h in held], [len(h[5]) for h in held]
        begin, n = first + np.repeat(offsets, units), size - SHINGLE + 1
        hashes, bands = np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
        if len(first):
            at, starts = gathered(begin, n)
            hashes, bands = whole_hashes(shingles[at], starts) ^ mark, signature(shingles, begin, begin + n)
        kinds = np.concatenate([np.zeros(len(held), np.int8), np.where(mark == 0, 1, 3).astype(np.int8), np.full(sum(windows), 2, np.int8)])
        every = np.concatenate([ids, np.repeat(ids, units), np.repeat(ids, windows)])
        where = np.concatenate([tags, np.repeat(tags, units) + first, np.repeat(tags, windows) + np.concatenate([h[5] for h in held])])
        sizes = np.concatenate([np.array([h[4] for h in held], np.int64), size, np.full(sum(windows), WINDOW)]).astype(np.int32)
        own = np.concatenate([np.zeros(len(held), np.uint64), hashes, *(h[6] for h in held)]).view(np.int64)
        none, b = (kinds == 0) | (kinds == 2), np.zeros((len(kinds), BANDS), np.int64)
        b[~none] = bands.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(every), pa.array(where), pa.array(sizes), pa.array(own), *(pa.array(np.ascontiguousarray(b[:, i]), mask=none) for i in range(BANDS))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, counts = word_hashes(text)
                shingles = runs(words, SHINGLE) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
                windows = runs(words, WINDOW) if len(words) >= WINDOW else np.zeros(0, np.uint64)
                take = chosen(windows)
                held.append((doc_id, tag_of(text), shingles, units_of(counts), len(words), take, windows[take]))
                many += len(words)
                if many >= WORDS_AT_ONCE:
                    yield rows(held)
                    held, many = [], 0
        if held:
            yield rows(held)

    schema = "kind byte, doc_id long, at long, size int, hash long, " + ", ".join(f"b{i} long" for i in range(BANDS))
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def alike(sets: list[np.ndarray], ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges of a forest of the links between different sets (sorted, distinct): exact Jaccard from the threshold on.

    Pairs that earlier links already join need not be compared.
    """
    label, edges = np.arange(len(sets)), []
    size = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    values, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, bounds = of[order], np.searchsorted(code[order], np.arange(len(values) + 1))
    begin = np.cumsum(size) - size
    for i in range(1, len(sets)):
        if (label[:i] == label[i]).all():
            continue
        earlier = [holders[bounds[c] : bounds[c + 1]] for c in code[begin[i] : begin[i] + size[i]].tolist()]
        both = np.bincount(np.concatenate(earlier), minlength=len(sets))[:i]
        for j in np.flatnonzero(both >= threshold * (size[:i] + size[i] - both) - 1e-9).tolist():
            if label[j] != label[i]:
                edges.append((int(ids[i]), int(ids[j])))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return edges


def linked(sets: list[np.ndarray], ids: np.ndarray, owner: np.ndarray, line: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """As `alike`: edges among those that are lines; and of each set that is linked with one of a lesser owner: its id
    and the least such owner. Sets are in order of their owners."""
    label, edges, least = np.arange(len(sets)), [], []
    size = np.array([len(s) for s in sets])
    if len(sets) <= FEW:
        members = [set(s.tolist()) for s in sets]
    else:
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        values, code = np.unique(flat, return_inverse=True)
        order = np.argsort(code, kind="stable")
        holders, bounds = of[order], np.searchsorted(code[order], np.arange(len(values) + 1))
        begin = np.cumsum(size) - size
    for i in range(1, len(sets)):
        if len(sets) <= FEW:
            both = np.array([len(members[i] & m) for m in members[:i]])
        else:
            earlier = [holders[bounds[c] : bounds[c + 1]] for c in code[begin[i] : begin[i] + size[i]].tolist()]
            both = np.bincount(np.concatenate(earlier), minlength=len(sets))[:i]
        near = np.flatnonzero(both >= threshold * (size[:i] + size[i] - both) - 1e-9)
        if len(near) and owner[near[0]] < owner[i]:
            least.append((int(ids[i]), int(owner[near[0]])))
        for j in near[line[near] & line[i] & (label[near] != label[i])].tolist():
            if label[j] != label[i]:
                edges.append((int(ids[i]), int(ids[j])))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return edges, least


def _small(rows: DataFrame, n: int) -> DataFrame:
    """rows as the side of a join that is sent to the executors, if their n entries are few."""
    return F.broadcast(rows) if n <= LISTED else rows


def _beside(docs: DataFrame, by_doc: DataFrame, n: int) -> DataFrame:
    """docs with the row of by_doc of the same id, if any: sent to the executors if its n entries are few, else joined."""
    return docs.join(_small(by_doc, n), "doc_id", "left")


def in_cells(members: DataFrame, keys: list[str]) -> DataFrame:
    """What is compared together: (g, hash), from members (keys, hash, n: members of the key). Keys with more than
    LARGEST members are compared in cells of two parts each, so every pair meets and no task holds more."""
    parts = F.ceil(F.col("n") * 2 / LARGEST).cast("int")
    own = F.pmod(F.hash("hash"), parts)
    cell = F.when(F.col("n") <= LARGEST, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    cells = members.select(*keys, "hash", F.explode(cell).alias("cell")).groupBy(*keys, "cell").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    groups = cells.filter(F.size("hashes") > 1).select("hashes").distinct()
    return cut(groups.withColumn("g", F.xxhash64("hashes")).select("g", F.explode("hashes").alias("hash")))


def colliding(paragraphs: DataFrame) -> DataFrame:
    """Groups (g, hash) of different paragraphs that collide in a band. Blocks that only meet others of their own
    document are left out. paragraphs: hash, owner, b0..., and line if there are blocks."""
    line = F.col("line") if "line" in paragraphs.columns else F.lit(True)
    keyed = paragraphs.select("hash", "owner", line.alias("line"), F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("k"))
    several = (F.min("owner") < F.max("owner")) | (F.count_if("line") > 1)
    counts = cut(keyed.groupBy("k").agg(F.count("*").alias("n"), several.alias("several")).filter("n > 1 and several").drop("several"))
    unshuffled(paragraphs.sparkSession)
    return in_cells(keyed.select("hash", "k").join(_small(counts, counts.count()), "k"), ["k"])


def with_sets(docs: DataFrame, groups: DataFrame, paragraphs: DataFrame, units: Callable) -> DataFrame:
    """groups (g, hash) with shingles (sorted, distinct, as bytes), owner and line of each hash; again where an owner's
    row is repeated.

    paragraphs: one row for each different paragraph: hash, owner (a document that has it); units finds them in a
    document's words.
    """
    wanted = cut(groups.select("hash").distinct().join(paragraphs.select("hash", "owner"), "hash").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("hash").alias("hashes")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, tuple[bytes, int, bool]] = {}
            for text, hashes, owner in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = word_hashes(text)
                first, n, shingles, starts, *mark = units(words, counts)
                mark = mark[0] if mark else np.zeros(len(starts), np.uint64)
                if len(starts):
                    own = (whole_hashes(shingles, starts) ^ mark).view(np.int64)
                    for i in np.flatnonzero(np.isin(own, hashes)).tolist():
                        s = starts[i]
                        out[int(own[i])] = np.unique(shingles[s : s + max(1, n[i] - SHINGLE + 1)]).tobytes(), owner, bool(mark[i] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array([x[i] for x in out.values()], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.bool_())))], ["hash", "shingles", "owner", "line"])

    listed = wanted.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    texts = _beside(docs, wanted, listed).filter("hashes is not null").select("text", "hashes", "doc_id")
    sets = texts.mapInArrow(tidy(shingled), "hash long, shingles binary, owner long, line boolean")
    return sets.join(_small(groups, groups.count()), "hash")


def by_group(rows: DataFrame, order: list[str], compared: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """compared(the rows of a group g in this order) for every group: a stream over sorted rows, one group at a time. Of
    rows of one hash the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    yield compared(group)
                    group = []
                if not group or row[1] != group[-1][1]:
                    group.append(row)
        if group:
            yield compared(group)

    return rows.select("g", "hash", "shingles", "owner", "line").repartition("g").sortWithinPartitions("g", *order).mapInArrow(tidy(run), schema)


def verified(docs: DataFrame, groups: DataFrame, paragraphs: DataFrame, threshold: float, units: Callable) -> DataFrame:
    """Edges (a, b) between hashes of different paragraphs, whose components are those of all pairs in a group of groups
    (g, hash) that have this exact Jaccard similarity. The others: as `with_sets` takes them."""

    def compared(group: list[tuple]) -> pa.RecordBatch:
        edges = alike([np.frombuffer(row[2], dtype=np.uint64) for row in group], np.array([row[1] for row in group]), threshold)
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in range(2)], ["a", "b"])

    return cut(by_group(with_sets(docs, groups, paragraphs, units), ["hash"], compared, "a long, b long").distinct())


def paragraph_links(docs: DataFrame, paragraphs: DataFrame, threshold: float, units: Callable = paragraph_shingles) -> DataFrame:
    """Edges (a, b) between hashes of different paragraphs, whose components are those of all verified collisions.

    paragraphs: one row for each different paragraph: hash, owner (a document that has it), b0...
    """
    return verified(docs, colliding(paragraphs), paragraphs, threshold, units)


def unit_links(docs: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of lines and blocks together (units: hash, owner, line, b0...): edges (a, b) as paragraph_links gives them among
    lines; and (hash, keeper), the least owner that a unit is linked with, if less than its own.

    Blocks overlap and so would chain through a whole document: they are linked directly, never by components.
    """

    def compared(group: list[tuple]) -> pa.RecordBatch:
        _, ids, sets, owner, line = zip(*group)
        edges, least = linked([np.frombuffer(x, dtype=np.uint64) for x in sets], np.array(ids), np.array(owner), np.array(line), threshold)
        rows = [*((a, b, None) for a, b in edges), *((a, None, k) for a, k in least)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "keeper"])

    pairs = with_sets(docs, colliding(units), units, unit_shingles)
    found = cut(by_group(pairs, ["owner", "hash"], compared, "a long, b long, keeper long").distinct())
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").groupBy(F.col("a").alias("hash")).agg(F.min("keeper").alias("keeper"))


def placed() -> list[Column]:
    """What `parts` packs into at: the text's tag and the first word."""
    return [F.shiftright("at", 32).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start")]


def removals(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """What repeats in docs (columns doc_id, text; others are ignored): (one row for each text with repeats: doc_id, tag
    of the text, spans array<struct<start, stop>> of words, kept_in array of the documents that keep the text,
    n_paragraphs, n_windows; one row for each text: doc_id, tag, size in words).

    Spans are in order and do not touch. Rows without id are neither compared nor changed; rows of one id are one
    document, each with the spans of its own text.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    with Scratch(docs.sparkSession) as written:
        taken = written(parts(own))
        units = taken.filter("kind in (1, 3)").groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(F.col("kind") == 1).alias("line"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
        units = written(units)
        edges, direct = unit_links(own, units, threshold)
        unshuffled(docs.sparkSession)
        nodes = components(edges)
        rooted = units.filter("line").select("hash", "owner", "last").join(nodes.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
        owners = rooted.groupBy("root").agg(F.min("owner").alias("keeper"), F.max("last").alias("last")).filter("keeper < last")
        again = rooted.select("hash", "root").join(owners, "root").select("hash", "keeper")
        equal = units.filter("owner < last and not line").select("hash", F.col("owner").alias("keeper"))
        again = cut(again.unionByName(equal).unionByName(direct).groupBy("hash").agg(F.min("keeper").alias("keeper")))
        lines = taken.filter("kind in (1, 3)").select("doc_id", *placed(), "size", "hash").join(_small(again, again.count()), "hash")
        lines = written(lines.filter("doc_id > keeper").select("doc_id", "tag", "start", "size", "keeper"))
        del rooted, owners, again, equal, nodes, edges, direct
        written.drop(units)
        unshuffled(docs.sparkSession)
        windows = taken.filter("kind = 2").select("doc_id", *placed(), "hash")
        # written first, so that a window that very many documents share is a skewed join, which the planner splits
        shared = _of_several(windows)
        hits = written(windows.join(_small(shared, shared.count()), "hash"))
        del shared
        unshuffled(docs.sparkSession)
        inner = hits.filter("doc_id > keeper")
        marks = inner.select("doc_id", "tag", "start", F.lit(WINDOW).alias("size"), "hash").unionByName(lines.select("doc_id", "tag", "start", "size", F.lit(None).cast("long").alias("hash")))
        marks = marks.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "size", "hash")).alias("marks")).filter(F.exists("marks", lambda m: m["hash"].isNotNull()))
        marks = written(marks.join(taken.filter("kind = 0").select("doc_id", placed()[0], F.col("size").alias("n_words")).distinct(), ["doc_id", "tag"]))
        edge = cut(outermost(marks))
        unshuffled(docs.sparkSession)
        near = written(around(own, hits.join(_small(edge, edge.count()), "hash"), spanned(marks)))
        unshuffled(docs.sparkSession)
        again = _of_several(near, F.max("open"))
        ends = near.filter("open").join(_small(again, again.count()), "hash").filter("doc_id > keeper").select("doc_id", "tag", "start", F.lit(WINDOW).alias("size"), "keeper", F.lit(None).cast("boolean").alias("line"))
        inner = inner.select("doc_id", "tag", "start", F.lit(WINDOW).alias("size"), "keeper", F.lit(False).alias("line"))
        found = lines.withColumn("line", F.lit(True)).unionByName(inner).unionByName(ends).groupBy("doc_id", "tag").agg(
            F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))).alias("spans"),
            F.collect_set("keeper").alias("kept_in"), F.count_if("line").alias("n_paragraphs"), F.count_if(~F.col("line")).alias("n_windows"),
        )

        return cut(joined_spans(found, "spans")), cut(taken.filter("kind = 0").select("doc_id", placed()[0], "size").distinct())


def _of_several(windows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The hashes that several documents have (and for which the aggregate is true): hash, keeper (the least id)."""
    wanted = F.lit(True) if wanted is None else wanted
    return cut(windows.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), wanted.alias("wanted")).filter("keeper < last and wanted").select("hash", "keeper"))


def _fields(lists: pa.ListScalar, *names: str) -> list[np.ndarray]:
    return [lists.values.field(c).to_numpy(zero_copy_only=False) for c in names]


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """How many of the words before each one of n + 1 places these spans do not cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) == 0)])


def outermost(marks: DataFrame) -> DataFrame:
    """Of the hits in marks (one row for each text with repeats: n_words, marks array<struct<start, size, hash>>, hash
    being null for lines and blocks) the hashes beside which other windows can matter, on their right or left: those from
    which less than STRIDE words lead to a word that no mark covers. hash, right, left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))]
            for own, n in zip(batch.column(0), batch.column(1).to_pylist()):
                start, size = _fields(own, "start", "size")
                hashes, hit = own.values.field("hash"), own.values.field("hash").is_valid().to_numpy(zero_copy_only=False)
                bare = covered(start, size, n)
                at = start[hit]
                right = bare[np.minimum(at + WINDOW + STRIDE - 1, n)] > bare[at + WINDOW]
                left = bare[at] > bare[np.maximum(at - STRIDE + 1, 0)]
                either = right | left
                found.append((hashes.drop_null().to_numpy()[either], right[either], left[either]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["hash", "right", "left"])

    sides = marks.select("marks", "n_words").mapInArrow(tidy(run), "hash long, right boolean, left boolean")
    return sides.groupBy("hash").agg(F.max("right").alias("right"), F.max("left").alias("left"))


def joined_spans(rows: DataFrame, column: str) -> DataFrame:
    """rows with the list of struct<start, stop> in the column made one of spans that do not touch."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, merged_lists(batch.column(at)))

    return rows.mapInArrow(tidy(joined), rows.schema)


def spanned(marks: DataFrame) -> DataFrame:
    """marks as spans that do not touch: doc_id, tag, spans array<struct<start, stop>>."""
    spans = F.transform("marks", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("stop")))
    return joined_spans(marks.select("doc_id", "tag", spans.alias("spans")), "spans")


def around(docs: DataFrame, hits: DataFrame, spans: DataFrame) -> DataFrame:
    """All windows that begin less than STRIDE words right or left, as asked, of one of the hits (doc_id, tag, start, right,
    left): doc_id, tag, start, hash, and open: whether it has words that no span of its text covers.

    Of a shared run the first and the last window that both documents took are hits, each less than STRIDE words from
    the run's end; so the run's other windows there are here from both documents, unless spans cover their words.
    """
    first = F.when(F.col("left"), F.greatest(F.col("start") - STRIDE + 1, F.lit(0))).otherwise(F.col("start"))
    last = F.when(F.col("right"), F.col("start") + STRIDE).otherwise(F.col("start") + 1)
    by_doc = hits.groupBy("doc_id", "tag").agg(F.collect_set(F.struct(first.alias("start"), last.alias("stop"))).alias("near"))
    by_doc = cut(joined_spans(by_doc, "near").join(spans, ["doc_id", "tag"], "left"))
    n = by_doc.agg(F.coalesce(F.sum(F.size("near") + F.coalesce(F.size("spans"), F.lit(0))), F.lit(0))).first()[0]
    names = ["doc_id", "tag", "start", "hash", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, many = [], 0
            for doc_id, tag, text, near, spans in zip(*(batch.column(i) for i in range(5))):  # one text at a time
                text = text.as_py()
                if tag_of(text) != tag.as_py():  # another text of this id
                    continue
                words, (first, last) = word_hashes(text)[0], _fields(near, "start", "stop")
                h = runs(words, WINDOW)
                bare = np.arange(len(words) + 1)
                if spans.is_valid:
                    a, b = _fields(spans, "start", "stop")
                    bare = covered(a, b - a, len(words))
                at = np.concatenate([np.arange(a, min(b, len(h))) for a, b in zip(first.tolist(), last.tolist())])
                held.append((np.full(len(at), doc_id.as_py(), np.int64), np.full(len(at), tag.as_py(), np.int32), at.astype(np.int32), h[at].view(np.int64), bare[at + WINDOW] > bare[at]))
                many += len(at)
                if many >= WORDS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                    held, many = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return _beside(docs, by_doc, n).filter("near is not null").select("doc_id", "tag", "text", "near", "spans").mapInArrow(tidy(run), "doc_id long, tag int, start int, hash long, open boolean")


def merged_lists(lists: pa.ListArray) -> pa.ListArray:
    """`merged` of each list of (start, stop)."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    start, stop = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
    of = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(offsets))
    order = np.lexsort((start, of))
    of, start, stop = of[order], start[order], stop[order]
    reach = np.maximum.accumulate((of << 32) + stop)
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] << 32) + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    values = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reach[last] & 0xFFFFFFFF).astype(np.int32))], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(len(lists) + 1)).astype(np.int32)), values)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words: each span goes up to the next word that stays, or to the end of its last word. Spans
    beyond the last word mean nothing."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in merged(spans):
        if start < len(words):
            out.append(raw[at : words[start][0]])
            at = words[stop][0] if stop < len(words) else words[-1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def of_length(least: int, more: bool) -> Column:
    """The spans of at least so many words, or the others."""
    long = lambda s: s["stop"] - s["start"] >= least
    return F.coalesce(F.filter("spans", long if more else lambda s: ~long(s)), F.array().cast("array<struct<start: int, stop: int>>"))


def words_in(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each different text of each document with an id: doc_id, n_words, removed_words (in runs of at least
    `least` repeated words), repeated_words (in all runs), n_paragraphs (repeated lines, and blocks of short lines, which
    overlap) and n_windows (repeated ones that were met first), before they are merged, spans (array of struct<start,
    stop>, words, of the runs to remove), short_spans (of the shorter runs), kept_in (sorted ids of the documents that
    keep what repeats here). An empty table gives no rows, a null text is one without words."""
    found, all_ = removals(docs)
    rows = all_.withColumnRenamed("size", "n_words").join(found, ["doc_id", "tag"], "left")
    rows = rows.withColumns({"long": of_length(least, True), "short_spans": of_length(least, False)}).withColumns({"removed_words": words_in("long"), "short": words_in("short_spans")})
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "removed_words", (F.col("removed_words") + F.col("short")).alias("repeated_words"), zero("n_paragraphs"), zero("n_windows"), F.col("long").alias("spans"), "short_spans", F.sort_array(F.coalesce("kept_in", F.array().cast("array<long>"))).alias("kept_in"))


def deduplicated(docs: DataFrame, length: str | None = None, least: int = LEAST) -> DataFrame:
    """docs (all columns kept) without the runs of at least `least` repeated words in text; `length`, if named, is a
    column that gets the new number of characters. Rows without id and rows without such runs stay as they are; emptied
    texts stay empty. Of rows of one id each loses what repeats in its own text."""
    found, _ = removals(docs)
    spans = found.withColumn("spans", of_length(least, True)).filter(F.size("spans") > 0)
    n = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    spans = spans.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list(F.struct("tag", "spans")).alias("_spans"))
    spans = F.broadcast(spans) if n <= LISTED else spans

    def clean(text: str | None, spans: list | None) -> str | None:
        if text is None or spans is None:
            return text
        own = tag_of(text)
        return next((without(text, [(x["start"], x["stop"]) for x in s["spans"]]) for s in spans if s["tag"] == own), text)

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, spans in batches:
            yield pd.Series([clean(t, s) for t, s in zip(text, spans)], dtype=object)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from tidy(each)(batches)

    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("_of"), "left")
    out = joined.withColumn("text", cleaned(F.col("text").cast("string"), "_spans"))
    if length:
        out = out.withColumn(length, F.when(F.col("_spans").isNull(), F.col(length)).otherwise(F.length("text").cast(docs.schema[length].dataType)))
    return out.select(*docs.columns)
