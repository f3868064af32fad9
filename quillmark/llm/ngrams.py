"""Character n-grams of whole texts as hashed bins, and bounded samples of labelled rows to learn from."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the n-gram hash (2 to this power); characters of a long text handled at a time.
BITS, AT_ONCE = 20, 1 << 17
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
BLANKS = re.compile(r"\s+")

_stamp = np.zeros(0, dtype=np.int32)


def bins(text: str, least: int, most: int) -> np.ndarray:
    """The different bins of the text's n-grams, least <= n <= most, of its lower-cased form with runs of blanks as one.

    Every n-gram of the whole text counts; a long text is read in windows that overlap by most - 1.
    """
    global _stamp
    if len(_stamp) != 1 << BITS:
        _stamp = np.zeros(1 << BITS, dtype=np.int32)
    text = " " + BLANKS.sub(" ", text.lower()).strip() + " "
    found = []
    for i in range(0, len(text), AT_ONCE):
        c = np.frombuffer(text[i : i + AT_ONCE + most - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h, parts = c * STEP, []
        for n in range(1, most + 1):
            if n > 1:
                h = (h[:-1] ^ c[n - 1 :]) * STEP
            if not len(h):
                break
            if n >= least:
                own = h[: AT_ONCE] ^ np.uint32(n)
                parts.append(((own ^ own >> np.uint32(15)) * MIX >> np.uint32(32 - BITS)).astype(np.int32))
        if not parts:
            continue
        all_ = np.concatenate(parts)
        nth = np.arange(len(all_), dtype=np.int32)
        _stamp[all_] = nth  # of equal bins the last one stays
        found.append(all_[_stamp[all_] == nth])
    if not found:
        return np.zeros(0, dtype=np.int32)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def sampled(docs: DataFrame, labelled: DataFrame, label: str, per_class: int, longest: int, most_rows: int) -> list[tuple[int, str, object]]:
    """(doc_id, text, label), in order of id: the bounded sample to learn from, the same rows each time.

    docs: doc_id, text; labelled: doc_id, label. Rows without id, text or label are left out first. Of each class about
    per_class rows, or most_rows over the number of classes if that is less, are drawn by a hash of their ids among the
    texts of `longest` characters at most; a class that has only longer texts is drawn among these and learnt from a
    window of `longest` characters whose place the id's hash decides. With more than most_rows classes the most frequent
    are learnt, ties by label. The classes' counts and the sample itself come to the driver, most_rows * longest
    characters at most but for chance.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("_n", F.length("text"))
    known = labelled.select("doc_id", F.col(label).alias("_label")).filter("doc_id is not null and _label is not null").distinct()
    rows = own.select("doc_id", (F.col("_n") <= longest).alias("_short")).join(known, "doc_id").distinct()
    sizes = rows.groupBy("_label").agg(F.count_if("_short").alias("short"), F.count("*").alias("n")).orderBy(F.desc("n"), "_label").limit(most_rows).collect()
    if not sizes:
        return []
    each = min(per_class, max(1, most_rows // len(sizes)))
    drawn = F.create_map(*[F.lit(x) for r in sizes for x in (r["_label"], min(1.0, each / (r["short"] or r["n"])))])
    short = F.create_map(*[F.lit(x) for r in sizes for x in (r["_label"], r["short"] > 0)])
    # top 30 bits of the hash as a number from 0 to 1
    place = lambda seed: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 34) / float(1 << 30)
    wanted = rows.filter((place("sample") < F.element_at(drawn, F.col("_label"))) & (F.col("_short") | ~F.element_at(short, F.col("_label"))))
    window = F.when(F.col("_n") <= longest, F.col("text")).otherwise(F.substring(F.col("text"), (F.lit(1) + F.floor(place("window") * (F.col("_n") - longest + 1))).cast("int"), F.lit(longest)))
    wanted = wanted.select(F.col("doc_id").alias("_id"), "_short", "_label")
    found = own.join(F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & ((F.col("_n") <= longest) == F.col("_short"))).select("doc_id", window.alias("text"), "_label").collect()
    return sorted({(r[0], r[1], r[2]) for r in found}, key=lambda r: (r[0], r[1]))


def squash(x: Column | np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
