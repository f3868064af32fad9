"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over ROLL bytes picks cut points from the content alone, so passages that documents share fall into the
same chunks wherever they stand. One pass over the texts gives the hashes of all chunks; those that occur again are
encoded once, in the document of the least id, and their ids are sent to all executors. What is sent is bounded: if all
of them are more, those that occur most often go. Every other chunk is encoded where it lies, so no text is shuffled.

Then the joins between chunks are repaired. The text around a cut is re-encoded, from a place where the split pattern
ends a piece in the left chunk to such a place in the right one. If the new ids agree with the left chunk's up to that
chunk's last such place, and with the right chunk's from its first such place on, they replace what lies between.
Otherwise the window grows; when it has grown over a whole chunk, that chunk is encoded with its neighbour.

Decoding goes the other way, from ids to bytes, chunk by chunk, and is checked as a round trip by its hash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, ready, tidy

#: Bytes of the rolling hash; chunks average about SHORTEST + 2 ** CHUNK_BITS bytes and have SHORTEST at least.
ROLL, CHUNK_BITS, SHORTEST = 16, 10, 256
#: Bytes of ids of shared chunks that are sent to every executor, by the estimate that an id (2 bytes) stands for 4 bytes.
SENT = 32 << 20
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places that a join's window takes on each side at first.
PLACES = 2


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rolling(raw: bytes) -> np.ndarray:
    """The polynomial hash of every ROLL bytes in a row, modulo 2 ** 64: twice as many bytes with each step."""
    h, m = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64), int(MULTIPLY)
    size = 1
    while size < ROLL:
        h = h[:-size] * np.uint64(pow(m, size, 1 << 64)) + h[size:]
        size *= 2
    return h


def cut_points(raw: bytes) -> list[int]:
    """Content-defined positions inside raw between characters, SHORTEST apart at least."""
    if len(raw) < 2 * SHORTEST:
        return []
    h = rolling(raw)
    hits = np.flatnonzero((h ^ h >> np.uint64(29)) * MULTIPLY >> np.uint64(64 - CHUNK_BITS) == 0) + ROLL
    out, last = [], 0
    for p in hits.tolist():
        while p < len(raw) and raw[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= SHORTEST and len(raw) - p >= SHORTEST:
            out.append(p)
            last = p
    return out


class ChunkCodec:
    """Encodes and decodes whole texts as the library does with the vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        added = sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for w, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.width = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.fast = self._engine(spec, vocab)
        self.alike: dict[str, bool] = {}
        self.kinds: dict[str, str] = {}

    def _engine(self, spec: dict, vocab: dict[str, int]):
        """A faster engine over the same merges, if ids follow the order of the merges; else None. Its tables of letters
        may be of another Unicode version: `same` finds out for each character that occurs."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        single = sum(len(w) == 1 for w in vocab)
        split = spec.get("pre_tokenizer") or {}
        special = {t["content"] for t in spec["added_tokens"]}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.by_chunks = plain and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not self.by_chunks or any(vocab.get(a + b) != single + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {self.bytes_of[i]: i for w, i in vocab.items() if w not in special}
        # joins a letter, a digit, a mark or a line end with the byte after it, so that the ids show what is one piece
        probe = {bytes([b]): b for b in range(256)} | {bytes([a, b]): 256 * (2 + i) + b for i, a in enumerate(b"a1.\n") for b in range(128, 256)}
        self.probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=probe, special_tokens={})
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def kind(self, c: str) -> str:
        """L, N, S (white space) or O, as the library's split has it; remembered."""
        got = self.kinds.get(c)
        if got is None:
            one = lambda s: len(self.lib.pre_tokenizer.pre_tokenize_str(s)) == 1
            got = self.kinds[c] = "L" if one("a" + c) else "N" if one("1" + c) else "S" if one("\n" + c) else "O"
        return got

    def same(self, text: str) -> bool:
        """Whether the faster engine classes all characters of the text as the library does."""
        if self.fast is None:
            return False
        if text.isascii():
            return True
        ok = True
        for c in set(text):
            if (got := self.alike.get(c)) is None:
                one = [len(self.probe.encode_ordinary(s + c)) == len(c.encode()) for s in "a1\n."]
                got = self.alike[c] = c.isascii() or "".join(k for k, j in zip("LNSO", one) if j) == self.kind(c)
            ok = ok and got
        return ok

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens, as the library gives them."""
        return self.fast.encode_ordinary(text) if self.same(text) else self.lib.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text between special tokens, and these (True). The library splits there first of all."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return [(False, text)]
        return [(i % 2 == 1, p) for i, p in enumerate(self.special.split(text)) if p]

    def ends(self, text: str, n: int, last: bool) -> list[int]:
        """The first (or last) n places inside a text at which a piece ends whatever stands before and after it: the
        kind of character changes, and the left one is neither white space, which a piece may start with, nor an
        apostrophe, which may take letters with it."""
        out: list[int] = []
        for i in range(len(text) - 1, 0, -1) if last else range(1, len(text)):
            a = text[i - 1]
            if a != "'" and (k := self.kind(a)) != "S" and k != self.kind(text[i]):
                out.append(i)
                if len(out) == n:
                    break
        return out

    def joined(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> tuple[list[int], str, list[int]]:
        """Two neighbours with their ids: the ids that are settled, and the text that is not, with its ids. What is not
        settled begins where a piece ends."""
        n = PLACES
        while True:
            a, b = self.ends(left, n, True), self.ends(right, n, False)
            if len(a) < 2 or len(b) < 2:
                return [], left + right, self.encode(left + right)
            # the window begins and ends at the outer places; up to the inner ones old and new ids have to agree
            old_left, old_right, new = self.encode(left[a[-1] :]), self.encode(right[: b[-1]]), self.encode(left[a[-1] :] + right[: b[-1]])
            same_left, same_right = self.encode(left[a[-1] : a[0]]), self.encode(right[b[0] : b[-1]])
            i, j = len(same_left), len(same_right)
            if (
                left_ids[len(left_ids) - len(old_left) :] == old_left and right_ids[: len(old_right)] == old_right and len(new) >= i + j
                and old_left[:i] == same_left == new[:i] and old_right[len(old_right) - j :] == same_right == new[len(new) - j :]
            ):
                return left_ids[: len(left_ids) - len(old_left)] + new, right[b[-1] :], right_ids[len(old_right) :]
            if len(a) < n and len(b) < n:
                return [], left + right, self.encode(left + right)
            n *= 2

    def __call__(self, text: str, known: dict[bytes, bytes] | None = None) -> list[int]:
        """Ids of a whole text. known: ids of chunks by their digest, as `packed` gives them."""
        if not self.by_chunks:
            return self.lib.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for special, part in self.parts(text):
            if special:
                out += self.lib.encode(part, add_special_tokens=False).ids
                continue
            open_, open_ids = "", []
            for chunk in pieces(part):
                got = known.get(digest(chunk)) if known else None
                own = chunk.decode()
                ids = self.encode(own) if got is None else np.frombuffer(got, dtype=self.width).tolist()
                if open_:
                    settled, open_, open_ids = self.joined(open_, open_ids, own, ids)
                    out += settled
                else:
                    open_, open_ids = own, ids
            out += open_ids
        return out

    def chunks(self, text: str) -> list[bytes]:
        return [c for special, p in self.parts(text) if not special for c in pieces(p)] if self.by_chunks else []

    def packed(self, chunk: bytes) -> bytes:
        return np.array(self.encode(chunk.decode()), dtype=self.width).tobytes()


def pieces(text: str) -> list[bytes]:
    raw = text.encode()
    at = [0, *cut_points(raw), len(raw)]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


@lru_cache(maxsize=2)
def codec_of(path: str) -> ChunkCodec:
    """One for each worker process."""
    return ChunkCodec(path)


def worth_most(again: DataFrame, most: int) -> DataFrame:
    """Of chunks (digest, n occurrences, size in bytes, ...) those that occur most often, about `most` bytes of ids in
    all: whole classes of equal n from the largest on, of the class that goes beyond it a share by digest. The classes'
    sums come to the driver; there are no more of them than the root of twice the occurrences."""
    cost = F.col("size") / 2 + 32
    least, share, left = None, 0.0, float(most)
    for r in sorted(again.groupBy("n").agg(F.sum(cost).alias("cost")).collect(), key=lambda r: -r["n"]):
        least, share = r["n"], min(1.0, max(0.0, left / r["cost"]))
        left -= r["cost"]
        if left <= 0:
            break
    place = F.shiftrightunsigned(F.xxhash64("digest"), 34) / float(1 << 30)
    return again.limit(0) if least is None else again.filter((F.col("n") > least) | ((F.col("n") == least) & (place < share)))


def shared_chunks(docs: DataFrame, tokenizer: str, written: Scratch) -> DataFrame:
    """Of the chunks that occur more than once in docs (id, text) those worth most: (digest, ids), each encoded once, in
    the document of the least id."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            found = [[(digest(c), len(c)) for c in codec.chunks(t)] for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d for f in found for d, _ in f], pa.binary()), pa.array([n for f in found for _, n in f], pa.int32())], ["id", "digest", "size"])

    all_ = docs.mapInArrow(tidy(cut_up), "id long, digest binary, size int")
    again = written(all_.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("size").alias("size")).filter("n > 1"))
    wanted = written(worth_most(again, SENT).groupBy("id").agg(F.collect_set("digest").alias("wanted")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            own = {}
            for text, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digests = set(digests)
                own |= {d: codec.packed(c) for c in codec.chunks(text) if (d := digest(c)) in digests}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], ["digest", "ids"])

    # the list of digests is bounded by SENT: each costs 32 bytes of it at least
    owners = docs.join(F.broadcast(wanted), "id").select("text", "wanted")
    return written(owners.mapInArrow(tidy(encode), "digest binary, ids binary").dropDuplicates(["digest"]))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every text of docs (columns doc_id, text; others are ignored).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row of docs. A null or empty text has no
    ids: the hashes are those of the empty string. Repeated rows give repeated rows; an empty table gives none.
    """
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with Scratch(spark) as written:
        encoded = shared_chunks(own.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text"), tokenizer, written)
        known = spark.sparkContext.broadcast({bytes(r["digest"]): bytes(r["ids"]) for r in encoded.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                got = codec(text, known.value)
                n.append(len(got))
                ids.append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, got)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(got).decode(errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
