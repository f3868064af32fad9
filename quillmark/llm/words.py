"""Words of whole texts, a batch at a time: what stands between blanks (space and U+0009 to U+000D), numbered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (a longer text is handled alone); bits of a position in a sort key.
PIECE, BITS = 4 << 20, 21


@dataclass
class Words:
    flat: pa.Array  # the words of all texts, one after another
    bounds: np.ndarray  # where each text's words begin, and the end: one more than texts
    ids: np.ndarray  # equal words have equal numbers

    @property
    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def filled(texts: pa.Array) -> pa.Array:
    """Texts as strings, null as the empty text."""
    return pc.fill_null(texts.cast(pa.string()), "")


def split(texts: pa.Array) -> Words:
    """The words of texts without null."""
    parts = pc.ascii_split_whitespace(texts)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = np.asarray(pc.binary_length(flat)) > 0  # blanks at an end give an empty part
    if not real.all():
        flat, bounds = flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    else:
        bounds = bounds - bounds[0]
    return Words(flat, bounds, np.asarray(flat.dictionary_encode().indices, dtype=np.int64))


def joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The words of each text joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of PIECE bytes of texts at most, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> list[memoryview]:
    """The bytes of each text, not copied."""
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at, at[1:])]


def ordered(a: np.ndarray, b: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, pos by (a, b, pos); all are less than n."""
    if n > 1 << BITS:
        o = np.lexsort((pos, b, a))
        return a[o], b[o], pos[o]
    key = np.sort(a << 2 * BITS | b << BITS | pos)
    mask = (1 << BITS) - 1
    return key >> 2 * BITS, key >> BITS & mask, key & mask


@dataclass
class Level:
    """Positions whose `length` words are equal in one class: pos is by class, then ascending; a class begins at each of
    first and comes from the class `parent` of the level before. Positions alone in their class are left out of the next
    level."""

    length: int
    pos: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    parent: np.ndarray


def levels(ids: np.ndarray, of: np.ndarray, most: int) -> Iterator[Level]:
    """The classes of equal factors of each text (ids: equal words, of: texts, ascending) of length 1, 2, ... most, as long
    as some class has several members."""
    n = len(ids)
    if not n:
        return
    a, _, pos = ordered(of, ids, np.arange(n), max(n, int(ids.max()) + 1, int(of[-1]) + 1))
    b, cls = ids[pos], np.arange(n + 1)
    for length in range(1, most + 1):
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        sizes = np.diff(np.append(first, len(pos)))
        cls[pos] = np.repeat(pos[first], sizes)  # a class is named by its first position
        yield Level(length, pos, first, sizes, a[first])
        pos = pos[np.repeat(sizes > 1, sizes)]
        if not len(pos):
            return
        # of the positions whose factor ends with the text one at most is in a class, and what follows it is of no class there
        a, b, pos = ordered(cls[pos], cls[pos + 1], pos, n + 1)
