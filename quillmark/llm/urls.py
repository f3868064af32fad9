"""URL filters: rules first, then gradient-boosted trees on lexical features.

The rules judge the urls they match; of several the longest counts. The trees judge the rest. They are trained on
labelled urls: those that the rules judge, or any table of urls with labels. Features are the lengths of the parts,
depth, shares of digits and other characters, entropy, parameter counts and statistics of the host's suffixes.

A suffix's share of blocked urls would tell the trees the very label of a row that it counts. So hosts are dealt to
folds, and a row is trained with the shares that the other folds' hosts have; a url that is judged gets those of all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import ready, tidy
from quillmark.llm.ngrams import squash

#: Bound of what is learnt from; trees, their depth, learning rate, cut points of a feature, least urls in a leaf.
LABELLED, TREES, DEPTH, RATE, CUTS, LEAST = 20_000, 40, 3, 0.2, 32, 20
#: Characters of a url that is learnt from at most; folds of hosts; rows that a suffix's share counts as having at the prior.
CHARACTERS, FOLDS, WEIGHT = 2_000, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = re.compile(r"^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)

Rules = list[tuple[str, str]]  # (rule, verdict): `host/path`, block or allow


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that matches: its host is the url's or a parent domain, its path the start of the url's."""
    out = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p)), F.lit(rule)).otherwise(out)
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def host_part(url: str | None) -> str:
    m = PART.match(url or "")
    return m[2].lower() if m else ""


def lexical(url: str | None) -> tuple[list[float], tuple[str, str]]:
    """Features of a url's letters, and the host's last label and last two."""
    url = url or ""
    m = PART.match(url)
    scheme, host, path, query, fragment = (x or "" for x in m.groups()) if m else ("", "", "", "", "")
    host = host.lower()
    n = max(1, len(url))
    depth = [p for p in path.split("/") if p]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), len(fragment), len(depth), host.count("."), max(map(len, depth), default=0), digits / n,
        sum(c.isdigit() for c in host) / max(1, len(host)), sum(not c.isalnum() for c in url) / n, entropy(host), entropy(path), entropy(url),
        query.count("=") + 0.0, query.count("&") + bool(query), host.count("-"), url.count("%"), scheme == "https", path.endswith("/"), "." in (depth[-1] if depth else ""), max(map(len, host.split("."))),
    ], suffixes(host)


@dataclass
class Model:
    rates: list[dict[str, tuple[float, float]]]  # of each suffix: smoothed share of blocked, log count
    prior: float
    offset: float
    trees: list[list[tuple[int, float, float]]]  # heap order: (feature or -1, threshold, value)

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for u in urls:
            x, ends = lexical(u)
            for rate, s in zip(self.rates, ends):
                x = x + list(rate.get(s, (self.prior, 0.0)))
            rows.append(x)
        return np.array(rows, dtype=np.float64)

    def score(self, urls: list[str | None]) -> np.ndarray:
        x = self.features(urls)
        z = np.full(len(x), self.offset)
        for tree in self.trees:
            feature, threshold, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            z += value[at]
        return squash(z)


def grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """One tree by the gain of second-order sums over each feature's bins; returns it and each row's value."""
    tree = [(-1, 0.0, 0.0)] * ((1 << DEPTH + 1) - 1)
    value, todo = np.zeros(len(gradient)), [(0, np.arange(len(gradient)))]
    while todo:
        at, rows = todo.pop()
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, -1, 0)
        if at < (1 << DEPTH) - 1 and len(rows) >= 2 * LEAST:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                own = codes[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(own, weights=w, minlength=len(c) + 1))[:-1] for w in (gradient[rows], hessian[rows], None))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            tree[at] = (-1, 0.0, -RATE * g / (h + 1))
            value[rows] = tree[at][2]
        else:
            tree[at] = (best[1], float(cuts[best[1]][best[2]]), 0.0)
            right = codes[rows, best[1]] > best[2]
            todo += [(2 * at + 1, rows[~right]), (2 * at + 2, rows[right])]
    return tree, value


def fold_of(host: str, folds: int = FOLDS) -> int:
    return zlib.crc32(host.encode("utf-8", "surrogatepass")) % folds


def suffix_rates(ends: list[str], y: np.ndarray, prior: float) -> dict[str, tuple[float, float]]:
    """Of each suffix: the smoothed share of blocked urls and the log count."""
    n, blocked = Counter(ends), Counter()
    for s, k in zip(ends, y.tolist()):
        blocked[s] += k
    return {s: ((blocked[s] + WEIGHT * prior) / (n[s] + WEIGHT), math.log1p(n[s])) for s in n}


def learn(rows: list[tuple[str, int]]) -> Model:
    """rows: (url, 1 to block or 0), a bounded sample. Without rows every score is 0.5."""
    y = np.array([r[1] for r in rows], dtype=np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    model = Model([{}, {}], prior, math.log(prior / (1 - prior)), [])
    if not len(y):
        return model
    part = np.array([fold_of(host_part(u)) for u, _ in rows])
    ends = [lexical(u)[1] for u, _ in rows]
    x = np.zeros((len(rows), 0))
    for k in range(FOLDS):  # each row with what the hosts of the other folds say of its suffixes
        mine, others = np.flatnonzero(part == k), np.flatnonzero(part != k)
        model.rates = [suffix_rates([ends[i][j] for i in others], y[others], prior) for j in (0, 1)]
        if len(mine):
            own = model.features([rows[i][0] for i in mine])
            x = np.zeros((len(rows), own.shape[1])) if not x.shape[1] else x
            x[mine] = own
    model.rates = [suffix_rates([e[j] for e in ends], y, prior) for j in (0, 1)]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    z = np.full(len(y), model.offset)
    for _ in range(TREES):
        p = squash(z)
        tree, value = grow(codes, cuts, p - y, p * (1 - p))
        model.trees.append(tree)
        z += value
    return model


def held_out(rows: list[tuple[str, int]], parts: int = 4, threshold: float = 0.5) -> dict[str, float]:
    """How the trees judge urls of hosts that they have not seen: rows (url, label), of which the hosts of one part in
    `parts` are left out. Counts, precision and recall of `block`."""
    left_out = [fold_of("held out " + host_part(u), parts) == 1 for u, _ in rows]
    model = learn([r for r, out in zip(rows, left_out) if not out])
    own = [r for r, out in zip(rows, left_out) if out]
    said, y = model.score([u for u, _ in own]) >= threshold if own else np.zeros(0, bool), np.array([k for _, k in own], dtype=bool)
    return {"urls": len(own), "blocked": int(y.sum()), "precision": float((said & y).sum() / max(1, said.sum())), "recall": float((said & y).sum() / max(1, y.sum())), "right": float((said == y).mean()) if own else 0.0}


def labelled(pages: DataFrame, rules: Rules) -> list[tuple[str, int]]:
    """(url, 1 to block or 0) of different urls that the rules judge: at most about LABELLED of them, those whose url
    hashes low enough, of CHARACTERS characters at most."""
    verdicts = dict(rules)
    own = pages.select(F.col("url").cast("string").alias("url")).withColumn("rule", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)).filter(F.col("rule").isNotNull() & (F.length("url") <= CHARACTERS))
    n = own.count()
    share = min(1.0, LABELLED / n) if n else 0.0
    rows = own.filter(F.shiftrightunsigned(F.xxhash64("url"), 34) / float(1 << 30) < share).distinct().collect()
    return sorted((r["url"], int(verdicts[r["rule"]] == "block")) for r in rows)


def fit(pages: DataFrame, rules: Rules) -> Model:
    """Learn from the urls of pages that the rules judge."""
    return learn(labelled(pages, rules))


def judge(pages: DataFrame, rules: Rules, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule (null if none matches), verdict (allow or block), score (the method's, 0 to 1: block)
    of each row of pages (columns page_id, url; others are ignored). Where a rule matches, the verdict is made in the
    plan and the score is null; only the other urls go to Python.

    A null url, or one without ://, has an empty host and path; the method judges it too. Repeated rows give repeated
    rows; an empty table gives none.
    """
    ready(pages.sparkSession)
    model = fit(pages, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = np.array(batch.column("verdict").is_null())
            score, said = np.full(batch.num_rows, np.nan), np.array(batch.column("verdict").to_pylist(), dtype=object)
            if rest.any():
                score[rest] = model.score(batch.column("url").filter(pa.array(rest)).to_pylist())
                said[rest] = np.where(score[rest] >= threshold, "block", "allow")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "host", "path", "rule")), pa.array(said.tolist(), pa.string()), pa.array(score, mask=~rest)], ["page_id", "host", "path", "rule", "verdict", "score"])

    url, said = F.col("url").cast("string"), F.create_map(*[F.lit(x) for r in rules for x in r])
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = own.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.element_at(said, F.col("rule")))).withColumn("url", F.when(F.col("rule").isNull(), F.col("url")))
    return own.mapInArrow(tidy(run), "page_id long, host string, path string, rule string, verdict string, score double")
