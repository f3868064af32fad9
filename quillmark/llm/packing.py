"""Packing: token sequences of a fixed window by best-fit decreasing.

Overlong documents are first cut into full windows; the rest is one piece. Pieces go, longest first, into the open
window with the least room that still fits. A segment tree indexed by remaining room finds that window.

Only lengths matter to the placement, so it runs on the histogram of piece lengths (at most one counter for each
length up to the window): windows with the same room are interchangeable and are handled as ranges of ids. The result
is a plan, a table of rules "pieces number r to r+m of length L lie in windows b.. at offset o, q in each", whose size
is bounded by the window size, not by the corpus. Pieces are numbered within their length without a global sort, and
look their place up in the plan. The text is read once and never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, numbered, ready, tidy

WINDOW = 4096
#: Words whose ids a Python worker remembers; above CACHE_WORDS it keeps the first CACHE_KEEP, which hold the common ones.
CACHE_WORDS, CACHE_KEEP = 400_000, 250_000


class RoomTree:
    """Segment tree over remaining room 0..window: which rooms have open windows; finds the least room of at least x."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        i = self.size + room
        self.used[i] = on
        while i > 1:
            i >>= 1
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def least(self, room: int) -> int | None:
        i = self.size + room
        if self.used[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing over a histogram {length: pieces}.

    Returns rows (length, first rank, first window, offset, pieces in each window), sorted by length and rank.
    """
    tree, open_ = RoomTree(window), {}
    rows: list[tuple[int, int, int, int, int]] = []
    new = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not open_.get(room):
                open_[room] = []
                tree.set(room, True)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                each = window // length
                put(window, new, -(-left // each))
                new += -(-left // each)
                continue
            first, n = open_[room].pop()
            if not open_[room]:
                tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, window - room, each))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
                first, n = first + full, n - full
            if n and 0 < left < each:
                rows.append((length, rank, first, window - room, left))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# The split pattern of the vocabulary file and the white space of its normaliser, for code points below 0x250.
LETTERS = "a-zªµºß-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACE = " \t\n\x0b\x0c\r\u0085 "
PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: Texts with other characters (where lower-casing and normal forms need the library) or special tokens go to the library whole.
OTHER = re.compile("[^\x00-įı-ɏ]|<\\|")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the library gives them; remembers words.

    Every word of the vocabulary ends in a token that has the end-of-word mark, so unknown words are encoded many at
    a time, joined by spaces, and the ids are split at those tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            for w in list(islice(self.known, CACHE_KEEP, None)):
                del self.known[w]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids = np.array(self.lib.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(some):  # a word that the library splits otherwise
                for w in some:
                    self.known[w] = np.array(self.lib.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            raw, stops = ids.tobytes(), (at * 4).tolist()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops))))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """One text at a time: beside the words remembered, the ids of a single text are held."""
        for text in texts:
            if not text:
                yield b""
            elif OTHER.search(text):
                yield np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                words = PIECES.findall(text.lower())
                try:
                    yield b"".join(map(self.known.__getitem__, words))
                except KeyError:
                    fresh = [w for w in set(words) if w not in self.known]
                    self.learn(fresh)
                    try:
                        yield b"".join(map(self.known.__getitem__, words))
                    except KeyError:  # the memory was cut down while this text's own words filled it
                        yield np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker process: its tasks share the words remembered."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, by: str | None = None) -> DataFrame:
    """Cut each document's ids (its text's, then `end_id`) into full windows and one rest: one row for each piece, with the
    document's value of `by` as part (empty without one)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int, str]] = []
            for doc_id, part, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                out.extend((doc_id, a, min(window, n - a), zlib.crc32(raw[4 * a : 4 * (a + window)]), n, part) for a in range(0, n, window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, [pa.int64()] * 5 + [pa.string()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])

    part = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part")).mapInArrow(tidy(cut_up), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part string")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, by: str | None = None) -> DataFrame:
    """Pack documents (columns doc_id, text; others are ignored) into sequences of at most `window` tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is the end id alone. An empty table gives no rows. Repeated rows are packed as often as they occur; null ids
    are kept. Pieces of one length are numbered in order of (doc_id, start, ids_crc32); rows equal in all three are
    interchangeable. A sequence holds documents of one value of the column `by` (few values), if it is given.
    """
    ready(docs.sparkSession)
    cutted = cut(pieces(docs, tokenizer, end_id, window, by))
    counts: dict[str, dict[int, int]] = {}
    for r in cutted.groupBy("part", "length").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["part"], {})[r["length"]] = r["n"]
    plans, first = {}, 0
    for part in sorted(counts):  # the sequences of a part follow those of the part before
        rules = plan(counts[part], window)
        rules[:, 2] += first
        last = [rule[2] + -(-(n - rule[1]) // rule[4]) for rule, n in zip(rules, [*np.where(rules[1:, 0] == rules[:-1, 0], rules[1:, 1], [counts[part][x] for x in rules[:-1, 0].tolist()]), counts[part][int(rules[-1, 0])]])]
        plans[part], first = (rules, rules[:, 0] << 48 | rules[:, 1]), int(max(last))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            parts, rule = np.array(batch.column("part").to_pylist(), dtype=object), np.zeros((batch.num_rows, 5), np.int64)
            for part in set(parts.tolist()):
                own = parts == part
                rules, keys = plans[part]
                rule[own] = rules[np.searchsorted(keys, length[own] << 48 | rank[own], side="right") - 1]
            nth, each = rank - rule[:, 1], rule[:, 4]
            cols |= {"sequence_id": pa.array(rule[:, 2] + nth // each), "offset": pa.array(rule[:, 3] + nth % each * length)}
            yield pa.RecordBatch.from_pydict(cols)

    ranked = numbered(cutted, ["part", "length"], ["doc_id", "start", "ids_crc32"], "rank", sum(sum(c.values()) for c in counts.values()))
    return ranked.mapInArrow(tidy(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
