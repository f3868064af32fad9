"""Quality rules, periodic runs and conversation repair against brute force, and on awkward tables."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import conversations, periods, rules, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, "a b c d e f g h a b c d e f g h tail"), (2, ""), (3, None), (4, " \n\t "), (5, "x " * 40), (6, "one\ntwo\none\n\n \none "), (7, "ab\x85c d\xa0e\x1cf"),
    (8, "日本 語 " * 9), (None, "no id " * 8), (None, None), (1, "a b c d e f g h a b c d e f g h tail"), (9, "# | $ <*> && %% word " * 20), (10, "w" * 70_000 + " z" * 30), (11, "\n\n"),
]
SCHEMA = "doc_id long, text string, start string, length string, _copies string, posterior string, n_words string, hash string"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(4)
    more = [(100 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(60)]
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in TEXTS + more], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Runs by comparing the words with themselves moved by each period."""
    found, inside = [], [set() for _ in w]
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= 2 * q:
                own = w[i : i + n]
                if not any(own[r:] == own[: n - r] for r in range(1, q)) and n >= least:
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_on_random_words():
    r = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(0, 4)):
            n, w = r.randint(0, 80), []
            if r.random() < 0.2:  # the word with most runs
                a, w = [0], [0, 1]
                while len(w) < n:
                    a, w = w, w + a
                w = w[:n]
            else:
                w = [r.randrange(r.choice([1, 2, 3])) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for least in (2, 12):
            got = periods.runs_of(np.array(sum(texts, []), dtype=np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least)
            at, want = 0, []
            for w in texts:
                want += [(s + at, n, q) for s, n, q in plain_runs(w, least)]
                at += len(w)
            assert [tuple(x) for x in got.tolist()] == want


def test_long_keys_are_ordered_alike(monkeypatch):
    r = np.random.default_rng(2)
    ids, of = r.integers(0, 3, 900), np.repeat(np.arange(9), 100)
    want = periods.runs_of(ids, of, 4).tolist()
    monkeypatch.setattr(words, "BITS", 3)
    assert periods.runs_of(ids, of, 4).tolist() == want


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_period_digests_equal_brute_force(spark, odd, docs):
    for table in (odd, docs.filter("n_chars < 1500")):
        got = Counter(tuple(r) for r in periods.digest(table).collect())
        assert got == Counter(plain_digest(r["doc_id"], r["text"]) for r in table.collect())
    assert periods.digest(odd.limit(0)).count() == periods.runs(odd.limit(0)).count() == 0


def test_runs_and_what_is_left(odd):
    got = sorted((str(r["doc_id"]), r["start"], r["length"], r["period"]) for r in periods.runs(odd).collect())
    assert got == sorted((str(r["doc_id"]), *x) for r in odd.collect() for x in plain_runs(WORD.findall(r["text"] or "")))
    left = {r["doc_id"]: r["text"] for r in periods.collapsed(odd).collect()}
    assert (left[1], left[3], left[5], left[6]) == ("a b c d e f g h tail", "", "x", "one two one one")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), max(Counter(w).values(), default=0), len(set(w))


def test_measures_equal_brute_force(odd, docs):
    for table in (odd, docs):
        got = Counter((r["doc_id"], *(r[c] for c in rules.MEASURES[:8])) for r in rules.measured(table).collect())
        assert got == Counter((r["doc_id"], *plain_measures(r["text"])) for r in table.collect())


def test_sliced_texts_are_measured_alike():
    texts = words.filled(pa.array([t for _, t in TEXTS]))
    assert [m.tolist() for m in rules.measures(texts.slice(3, 6))] == [m[3:9].tolist() for m in rules.measures(texts)]
    assert [m.tolist() for m in rules.measures(texts.slice(0, 0))] == [[]] * len(rules.MEASURES)


def test_quality_follows_the_votes(spark, odd, docs):
    own = rules.measured(docs)
    model = rules.fit(own)
    votes = own.select("doc_id", *[r.vote().alias(r.name) for r in rules.RULES]).toPandas()
    want = dict(zip(votes["doc_id"], rules.posterior(votes.drop(columns="doc_id").to_numpy(), model)))
    for r in rules.quality(docs).collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["posterior"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and r["posterior"] >= 0.5)
    assert rules.quality(odd).count() == odd.count()
    assert rules.quality(odd.limit(0)).count() == 0


def test_estimate_finds_the_accuracies_that_votes_were_drawn_with():
    r = np.random.default_rng(3)
    good = r.random(20_000) < 0.85
    right = np.column_stack([np.full(6, 0.97), [0.5, 0.5, 0.4, 0.4, 0.6, 0.3]])
    correct = r.random((len(good), 6)) < np.where(good[:, None], right[:, 0], right[:, 1])
    votes = np.where(r.random((len(good), 6)) < 0.1, 0, np.where(correct == good[:, None], 1, 2))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.estimate(patterns, counts.astype(float))
    assert abs(model.good - 0.85) < 0.03 and np.abs(model.right - right).max() < 0.06
    assert ((rules.posterior(votes, model) >= 0.5) == good).mean() > 0.93
    assert rules.estimate(np.zeros((0, 6), int), np.zeros(0)).good == rules.GOOD


def test_quality_keeps_the_good_and_finds_the_bad(spark):
    sf = "/root/testdata/sf0.01"
    rows = rules.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert np.mean(kept[1]) >= 0.99 and np.mean(kept[0]) <= 0.1


STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_plan(roles: tuple, faults: tuple) -> tuple[int, str]:
    """The cheapest edits over all sequences of single edits, least letters first."""

    @functools.cache
    def best(i: int, state: str, inserted: int) -> tuple[int, str]:
        ways = [(0, "")] if i == len(roles) and state in "0a" else []
        follow = []
        if i < len(roles):
            follow.append((4, "D", i + 1, state, inserted))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if (state, roles[i]) in STEP:
                    follow.append((extra, "K", i + 1, STEP[state, roles[i]], 0))
                follow += [(3 + extra, "R", i + 1, r, 0) for r in "ua" if (state, r) in STEP]
        if inserted < 3:
            follow += [(3, "I", i, r, inserted + 1) for r in "ua" if (state, r) in STEP]
        for cost, letter, *to in follow:
            rest = best(*to)
            ways.append((cost + rest[0], letter + rest[1]))
        return min(ways, default=(10**9, ""))

    return best(0, "0", 0)


def test_plan_equals_brute_force():
    r, code = random.Random(8), {"": conversations.FINE, "blank": conversations.BLANK, "duplicate": conversations.DUPLICATE, "truncated": conversations.CUT}
    for _ in range(3000):
        n = r.randint(0, 9)
        roles = tuple(r.choice("uuaasx") for _ in range(n))
        faults = tuple(r.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n))
        assert conversations.plan(bytes(conversations.STATE.get(x, conversations.OTHER) for x in roles), bytes(code[x] for x in faults)) == plain_plan(roles, faults)


def plain_conversation(rows: list[tuple]) -> tuple:
    """rows (turn, role, text) after damage, in order: the digest without conv_id."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = plain_plan(tuple(initials), tuple(faults)) if rows else (0, "")
    out, at, want = [], iter(rows), "u"
    for letter in audit:
        role, text = ({"u": "user", "a": "assistant"}[want], "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        role = {"u": "user", "a": "assistant"}[want] if letter == "R" else role
        out.append(f"{role}:{text}")
        want = "a" if role[:1] == "u" else "u"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_conversations(rows: list[tuple]) -> dict:
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {conv: plain_conversation(sorted(own, key=order)) for conv, own in by.items()}


def test_conversation_digests_equal_brute_force(spark, sf_dir):
    r = random.Random(6)
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(14)]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "no", "", " \n", None, "Why? ", "ok!\x0b", "long " * 300 + "."])) for _ in range(500)]
    rows += [(7, 3, "user", "Yes.")] * 40 + [(200, 5, None, None), (201, None, "user", "Alone.")]
    odd = spark.createDataFrame([(*x, "c", "f", 1, "n") for x in rows], "conv_id long, turn long, role string, text string, conv string, first string, kind int, n string")
    small = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for table, own in ((odd, rows), (small, [tuple(x) for x in small.select("conv_id", "turn", "role", "text").collect()])):
        got = conversations.digest(table).collect()
        assert len(got) == len({x["conv_id"] for x in got})
        assert {x["conv_id"]: tuple(x)[1:] for x in got} == plain_conversations(own)
    assert conversations.digest(odd.limit(0)).count() == 0


def test_repaired_turns_are_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by = {}
    for r in conversations.repaired(conversations.damaged(table)).orderBy("conv_id", "position").collect():
        by.setdefault(r["conv_id"], []).append(r)
    sums = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digest(table).collect()}
    for conv, own in by.items():
        assert [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in own))
        assert sums[conv] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest()
