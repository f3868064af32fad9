"""Document fingerprints: SimHash over weighted terms, found again through permuted block tables.

Every term of a text (a word of its lower-cased form) votes with its weight on each of 64 bits, for or against as the
term's hash has the bit or not; the fingerprint is the signs of the sums. Weights grow with the root of the term's
count and with its length, so that the short words all texts share decide little.

For a Hamming radius r the bits are cut into r + 2 blocks, of which two at least agree. A table for each pair of
blocks holds all fingerprints under those blocks' bits, as if permuted to the front; what meets there is verified.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, ready, tidy
from quillmark.llm.components import components
from quillmark.llm.simhash import first_keyed, links

BITS, SHORT = 64, 3
#: Words whose hashes a Python worker remembers. Documents of a range; bounds that are sent to every executor at most (8
#: bytes each): with more documents ranges grow, at 10 billion to 10,000 documents.
REMEMBERED, RANGE_ROWS, BOUNDS = 400_000, 2_000, 1_000_000

_hashes: dict[str, int] = {}


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; 0 if it has no terms."""
    counts = Counter((text or "").lower().split())
    if not counts:
        return 0
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    sums, words = np.zeros(BITS), list(counts)
    for i in range(0, len(words), 65_536):
        some, h = words[i : i + 65_536], []
        for w in some:
            x = _hashes.get(w)
            if x is None:
                x = _hashes[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            h.append(x)
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        n = np.fromiter(map(counts.__getitem__, some), np.float64, len(some))
        size = np.minimum(np.fromiter(map(len, some), np.float64, len(some)), 32)
        weight = np.sqrt(n) * np.where(size <= SHORT, 0.25, size)
        sums += 2 * (weight.astype(np.float32) @ bits) - weight.sum()
    return int(np.packbits(sums > 0, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def search(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs of a query fingerprint and a different or equal fingerprint within the radius.

    queries (fp) and fps (fp), longs, each without repetition: returns query, fp, distance. What comes back are the
    matches themselves; to group a whole table, `grouped` avoids listing them.
    """
    own = first_keyed(queries.select("fp"), radius).withColumnRenamed("fp", "query")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return own.join(first_keyed(fps.select("fp"), radius), ["t", "k"]).withColumn("distance", distance).filter(F.col("distance") <= radius).select("query", "fp", "distance").distinct()


def grouped(rows: DataFrame, radius: int) -> DataFrame:
    """rows (doc_id, fp): group_id of each fp, the least doc_id that links of at most the radius reach."""
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(own.select("fp"), radius))
    rooted = own.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("group_id")), "root").select("fp", "group_id")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of descending doc_id, each sorted, with one row more: the document that follows.

    Returns rows (bucket, follows, doc_id, text) for one pass over sorted partitions. Range bounds are ids that occur,
    so the first document of a range is known by its id and is dealt to the range before it as well; the first of all
    follows the last. The text is shuffled once.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # rows without id come last
    docs = docs.withColumn("_key", key)
    n = docs.count()
    ranges = max(1, min(BOUNDS, n // RANGE_ROWS))
    found = docs.stat.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    ends = np.array(sorted(set(found)))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, ids.to_numpy(dtype=np.float64)).astype(np.int32))

    # quantiles are doubles and may not occur; the greatest id of each part does
    firsts = [r[0] for r in docs.groupBy(part("_key")).agg(F.max("_key")).select("max(_key)").collect()]
    ascending = np.array(sorted(firsts) or [0], dtype=np.int64)

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        own = len(ascending) - 1 - np.searchsorted(ascending, ids.to_numpy(dtype=np.int64))
        first = np.isin(ids.to_numpy(dtype=np.int64), ascending)
        return pd.Series([[b, (b - 1) % len(ascending)] if f else [b] for b, f in zip(own.tolist(), first.tolist())])

    dealt = docs.select("doc_id", "text", "_key", F.posexplode(buckets("_key")).alias("follows", "bucket"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "follows", F.desc("_key"), F.xxhash64("text"), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each row of docs (columns doc_id, text; others are ignored), with the document that follows in descending
    order of doc_id: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp.

    The edited text is the text with its last n_chars // 2 characters replaced by as many of the next document's first.
    A null text counts as empty. Rows of one id follow each other in order of a hash of their text, rows without id
    come last. An empty table gives none; a single row is followed by itself.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, str, int, int] | None = None  # id, text, fingerprint, bucket
        for batch in batches:
            out: list[tuple] = []
            for bucket, follows, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is None and follows:
                    continue  # a second copy of the row that followed
                fp = fingerprint(text)
                if last is not None:
                    n = len(last[1])
                    edited = last[1][: n - n // 2] + text[: n // 2]
                    out.append((last[0], n, hashlib.sha256(edited.encode()).hexdigest(), last[2], fingerprint(edited), fp))
                last = None if follows else (doc_id, text, fp, bucket)
            cols = list(zip(*out)) if out else [()] * 6
            longs = lambda c: pa.array(np.array(c, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *map(longs, cols[3:])], ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_next(own).select("bucket", "follows", "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long")


def compare(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 lowercase hex digits), near_edited, near_next
    (1 minus the share of differing bits), group_id (least doc_id that links of at most `radius` bits reach)."""
    rows = cut(edited_pairs(docs))
    near = lambda c: 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / F.lit(float(BITS))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(grouped(rows.select("doc_id", "fp"), radius), "fp").select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"), "group_id"
    )
