"""Runs of periodic words, by Crochemore's partition refinement.

Positions of a text are in one class of level p if their p words are equal. A class is refined for p + 1 by the classes
of the positions one further on. Two neighbours of a class of level p at distance p start a square, and since a root that
is itself periodic has a nearer neighbour, only squares of primitive roots show; squares of one period at successive
positions are a run.

The first LEVELS levels, where most positions become the only ones of their class, are done for many texts at once with
sorts; from there on only those subclasses split others that are not the largest of the class they come from, so that a
position is moved a logarithmic number of times however long the repeats are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import fold, ready, tidy
from quillmark.llm.words import Words, filled, joined, levels, pieces, raw, split

#: Least words of a run; levels done by sorts.
LEAST, LEVELS = 12, 6
NO_RUN = np.zeros((0, 3), dtype=np.int64)


def _runs_of(squares: np.ndarray, period: int) -> np.ndarray:
    """(start, length, period) of the squares' positions, ascending."""
    if not len(squares):
        return NO_RUN
    first = np.flatnonzero(np.concatenate([[True], np.diff(squares) != 1]))
    count = np.diff(np.append(first, len(squares)))
    return np.column_stack([squares[first], count + 2 * period - 1, np.full(len(first), period)])


def _by_smaller_parts(level: int, cls: dict[int, int], members: dict[int, list[int]], small: list[list[int]]) -> Iterator[tuple[int, list[int]]]:
    """Go on from a level's classes of several members (cls: of a position, members: ascending) and the positions of its
    small subclasses: (p, positions of squares of period p) for each later level p that has some."""
    size, head, after, before, gaps = {}, {}, {}, {}, {}
    for c, own in members.items():
        size[c], head[c], before[own[0]] = len(own), own[0], -1
        for a, b in zip(own, own[1:]):
            after[a], before[b] = b, a
            if b - a > level:
                gaps.setdefault(b - a, []).append(a)
        after[own[-1]] = -1
    name, p = max(members, default=0) + 1, level
    while small:
        touched: dict[int, list[list[int]]] = {}
        for own in small:
            if len(own) == 1:
                if (c := cls.get(own[0] - 1)) is not None:
                    touched.setdefault(c, []).append([own[0] - 1])
                continue
            parts: dict[int, list[int]] = {}
            for j in own:
                if (c := cls.get(j - 1)) is not None:
                    parts.setdefault(c, []).append(j - 1)
            for c, part in parts.items():
                touched.setdefault(c, []).append(part)
        p, small = p + 1, []
        for c, parts in touched.items():
            rest = size[c] - sum(map(len, parts))
            if not rest:  # the largest part keeps the class's name
                stays = max(range(len(parts)), key=lambda k: len(parts[k]))
                rest = len(parts.pop(stays))
                if not parts:
                    continue
            largest = max(range(len(parts)), key=lambda k: len(parts[k]))
            for k, part in enumerate(parts):
                for i in part:
                    a, b = before[i], after[i]
                    if a >= 0:
                        after[a] = b
                        if b - a >= p:
                            gaps.setdefault(b - a, []).append(a)
                    else:
                        head[c] = b
                    if b >= 0:
                        before[b] = a
                if len(part) == 1:
                    del cls[part[0]]
                    after[part[0]] = -1
                else:
                    name += 1
                    size[name], head[name], before[part[0]] = len(part), part[0], -1
                    for a, b in zip(part, part[1:]):
                        cls[a], after[a], before[b] = name, b, a
                        if b - a >= p:
                            gaps.setdefault(b - a, []).append(a)
                    cls[part[-1]], after[part[-1]] = name, -1
                if k != largest or rest >= len(part):
                    small.append(part)
            size[c] = rest
            if rest < len(parts[largest]):
                own, i = [], head[c]
                while i >= 0:
                    own.append(i)
                    i = after[i]
                small.append(own)
            if rest == 1:
                del cls[head[c]]
        if found := gaps.pop(p, None):
            if squares := sorted({i for i in found if after[i] == i + p}):
                yield p, squares


def runs_of(ids: np.ndarray, of: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run with at least max(least, 2 * period) of the words (ids: equal words of a text
    have equal numbers; of: their texts, ascending), by start, then period. Runs do not cross texts."""
    found, level = [NO_RUN], None
    for level in levels(ids, of, LEVELS):
        near = np.diff(level.pos) == level.length
        near[level.first[1:] - 1] = False
        found.append(_runs_of(np.sort(level.pos[:-1][near]), level.length))
    if level is not None and level.length == LEVELS and (level.sizes > 1).any():
        new = np.flatnonzero(np.concatenate([[True], level.parent[1:] != level.parent[:-1]]))
        of_parent = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(level.first))))
        largest = np.zeros(len(level.first), dtype=bool)
        largest[np.lexsort((-level.sizes, of_parent))[new]] = True
        all_, ends = level.pos.tolist(), np.append(level.first, len(level.pos)).tolist()
        members = {all_[s]: all_[s:e] for s, e in zip(ends, ends[1:]) if e - s > 1}
        small = [all_[s:e] for s, e, most in zip(ends, ends[1:], largest.tolist()) if not most]
        later = _by_smaller_parts(LEVELS, {i: c for c, own in members.items() for i in own}, members, small)
        found += [_runs_of(np.array(squares), p) for p, squares in later]
    all_runs = np.concatenate(found)
    all_runs = all_runs[all_runs[:, 1] >= least]
    return all_runs[np.lexsort((all_runs[:, 2], all_runs[:, 0]))]


def outside(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def planted(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words that stand in each place after the texts whose hash ends in 0 are made periodic: from word
    a = g % n on, with g = hash // 10, word i becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    take, begin, n = np.arange(len(words.flat)), words.bounds[:-1], np.diff(words.bounds)
    for k in np.flatnonzero((hashes % 10 == 0) & (n > 0)):
        g = int(hashes[k]) // 10
        a = g % int(n[k])
        p = 1 + (int(n[k]) - a) // (3 + g % 8)
        take[begin[k] + a : begin[k] + n[k]] = begin[k] + a + np.arange(n[k] - a) % p
    return take


def _found(docs: DataFrame, give, schema: str, hashes: bool = False) -> DataFrame:
    """Runs of each piece of the rows (doc_id, text, hash), handed to give(piece, words, runs)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                words = split(filled(piece.column(1)))
                if hashes:
                    take = planted(words, np.asarray(piece.column(2)))
                    words = Words(words.flat.take(pa.array(take)), words.bounds, words.ids[take])
                yield give(piece, words, runs_of(words.ids, words.of))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([fold(F.col("doc_id"), 1 << 32).alias("hash")] if hashes else []))
    return own.mapInArrow(tidy(run), schema)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of LEAST words or more in the texts of docs (doc_id, text; other columns
    are ignored): words from start on, with the smallest period, at least two of them, extended as far as it goes.

    A null or empty text has none; repeated rows give theirs each time; rows are never gathered, so no id or text is hot.
    """

    def give(piece: pa.RecordBatch, words: Words, found: np.ndarray) -> pa.RecordBatch:
        k = np.searchsorted(words.bounds, found[:, 0], side="right") - 1
        return pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(k)), pa.array(found[:, 0] - words.bounds[k]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["doc_id", "start", "length", "period"])

    return _found(docs, give, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words outside all runs and the first period of each run, joined by one space."""

    def give(piece: pa.RecordBatch, words: Words, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), _left(words, found)], ["doc_id", "text"])

    return _found(docs, give, "doc_id long, text string")


def _left(words: Words, found: np.ndarray) -> pa.Array:
    if not len(found):
        return joined(words.flat, words.bounds)
    keep = outside(found, len(words.flat))
    return joined(words.flat.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[words.bounds])


def digest(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text), after the texts that `planted` names are made periodic: doc_id, n_runs, the
    longest run's start, length, period and exponent_milli (ties: smallest start, then period; null without a run), sha256
    of all runs and of the text that is left.

    A null text has no words; a null id is hashed as an empty text. Repeated rows give repeated rows, an empty table none.
    """

    def give(piece: pa.RecordBatch, words: Words, found: np.ndarray) -> pa.RecordBatch:
        rows = len(piece)
        k = np.searchsorted(words.bounds, found[:, 0], side="right") - 1
        count = np.bincount(k, minlength=rows)
        own = found - np.column_stack([words.bounds[k], np.zeros_like(found[:, 1:])])
        best: list[tuple | None] = [None] * rows
        order = np.lexsort((own[:, 2], own[:, 0], -own[:, 1], k))
        for i in order[np.concatenate([[True], np.diff(k[order]) != 0])] if len(order) else []:
            s, length, p = own[i].tolist()
            best[k[i]] = s, length, p, 1000 * length // p
        ends, listed = np.concatenate([[0], np.cumsum(count)]).tolist(), own.tolist()
        sums = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in listed[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:])]
        columns = [pa.array([b and b[j] for b in best], pa.int64()) for j in range(4)]
        left = [hashlib.sha256(t).hexdigest() for t in raw(_left(words, found))]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(count), *columns, pa.array(sums, pa.string()), pa.array(left, pa.string())], names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _found(docs, give, schema, hashes=True)
