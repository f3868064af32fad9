"""Each training-data operator against brute force, an exact round trip or held-out labels, and on awkward tables."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import bpe, components, fingerprints, language, ngrams, packing, sharding, simhash, substrings, toxicity, transport, urls
from quillmark.llm.queries import URL_RULES

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, shard string, size string, t string, k string, n string"


def lorem(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = lorem(1, 60_000)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with names used inside."""
    texts = [(1, "The cat sat on the mat"), (2, "the cat sat on the mat"), (3, ""), (4, None), (5, " \n\t "), (6, LONG), (7, LONG + " end"), (8, "12 34 !?"), (9, "日本語 テキスト"), (1, "The cat sat on the mat"), (None, "no id here"), (None, None), (10, "ÀÉ naïve İstanbul ǅ ΑΣ <|endoftext|> x"), (11, "a\x85b\xa0c  d"), (12, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None, 0.5, 7, "s", "z", "t", "k", "n") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_packing_places_every_id_once(spark, docs, odd, none):
    lib = Tokenizer.from_file(WORDS)
    for table in (docs, odd):
        rows = packing.pack(table, WORDS).collect()
        texts = table.select("doc_id", "text").collect()
        whole = {(r["doc_id"], r["text"]): [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in texts}
        have = sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
        want = sorted((str(r["doc_id"]), a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], dtype="<u4").tobytes()), len(ids)) for r in texts for ids in [whole[r["doc_id"], r["text"]]] for a in range(0, len(ids), 4096))
        assert have == want
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in by.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= 4096
    assert packing.pack(none, WORDS).count() == 0


def test_the_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(30):
        window = r.choice([8, 20, 64])
        lengths = sorted((r.randint(1, window) for _ in range(r.randint(0, 200))), reverse=True)
        rooms: list[int] = []
        for x in lengths:
            fits = [(room, -i) for i, room in enumerate(rooms) if room >= x]
            if fits:
                rooms[-min(fits)[1]] -= x
            else:
                rooms.append(window - x)
        counts = {x: lengths.count(x) for x in lengths}
        used: dict[int, list] = {}
        rules = packing.plan(counts, window)
        for x, n in counts.items():
            own = rules[rules[:, 0] == x]
            for rank in range(n):
                rule = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                nth = rank - rule[1]
                used.setdefault(int(rule[2] + nth // rule[4]), []).append((int(rule[3] + nth % rule[4] * x), x))
        assert sorted(window - sum(x for _, x in own) for own in used.values()) == sorted(rooms)
        for own in used.values():
            end = 0
            for at, x in sorted(own):
                assert at == end
                end += x


def test_bpe_equals_the_library(docs, odd, none):
    lib = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for table in (docs, odd):
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
        assert sorted(map(str, (tuple(r) for r in bpe.round_trip(table, BYTES).collect()))) == sorted(map(str, want))
    assert bpe.round_trip(none, BYTES).count() == 0


def test_bpe_joins_agree_wherever_chunks_are_cut(monkeypatch):
    codec, r = bpe.ChunkCodec(BYTES), random.Random(2)
    assert codec.fast is not None
    alphabets = ("ab é'st \n\t.,1²–", "ab", "ab ", " \n", "'s re ll", "日本語テキスト。 \n漢字", "अआ इ̀́ا ب ث‍", "👍🏽 a　b\xa0c", "Ωα ∑ ½ Ⅷ ٣ 𝟘 𐍈ꟸ", "x<|endoftext|>y'll 3")
    for shortest, bits in ((256, 10), (24, 4)):
        monkeypatch.setattr(bpe, "SHORTEST", shortest)
        monkeypatch.setattr(bpe, "CHUNK_BITS", bits)
        for alphabet in alphabets:
            for _ in range(30):
                text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 3000 if shortest > 100 else 600)))
                if r.random() < 0.2:
                    text = text[: len(text) // 2] + "<|endoftext|>" + text[len(text) // 2 :]
                ids = codec.lib.encode(text, add_special_tokens=False).ids
                assert codec(text) == ids
                known = {bpe.digest(c): codec.packed(c) for c in codec.chunks(text)}
                assert codec(text, known) == ids


def test_bpe_chunks_of_a_shared_passage_are_shared(spark, monkeypatch):
    shared = lorem(3, 2000)
    a, b = set(bpe.pieces(lorem(4, 90) + " — " + shared)), set(bpe.pieces(lorem(5, 70) + " 日本 " + shared))
    assert len(a & b) > 0.6 * min(len(a), len(b))  # the same wherever the passage stands
    docs = spark.createDataFrame([(1, lorem(4, 90) + " " + shared), (2, lorem(5, 70) + " " + shared), (3, lorem(6, 900)), (4, lorem(6, 900)), (4, "other"), (None, shared)], "doc_id long, text string")
    want = sorted(map(str, map(tuple, bpe.round_trip(docs, BYTES).collect())))
    for sent in (0, 700):  # nothing is shared, or some chunks only
        monkeypatch.setattr(bpe, "SENT", sent)
        assert sorted(map(str, map(tuple, bpe.round_trip(docs, BYTES).collect()))) == want
    again = spark.createDataFrame([(bytes([i]), 2 + i // 8, 100) for i in range(24)], "digest binary, n long, size int")
    assert bpe.worth_most(again, 8 * 82).count() == 8 and bpe.worth_most(again, 10_000).count() == 24 and bpe.worth_most(again, 0).count() == 0
    assert {r["n"] for r in bpe.worth_most(again, 8 * 82).collect()} == {4} and 8 <= bpe.worth_most(again, 12 * 82).count() <= 16
    assert bpe.worth_most(again.limit(0), 100).count() == 0


def test_bpe_engines_are_compared_for_each_character():
    codec = bpe.ChunkCodec(BYTES)
    for c in map(chr, [*range(0x80, 0x600, 7), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x10FFFD]):
        for text in (f"a{c}b", f"1{c}2", f". {c}{c}.", f"\n{c} x"):
            if codec.same(text):
                assert codec.fast.encode_ordinary(text) == codec.lib.encode(text, add_special_tokens=False).ids


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], ids: list, radius: int) -> list:
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {k: min((d for d, x in zip(ids, label) if x == k and d is not None), default=None) for k in set(label)}
    return [least[x] for x in label]


def test_simhash_equals_brute_force(docs, odd, none):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r["text"][:40_000] if r["text"] and len(r["text"]) < 40_000 else r["text"]) if not r["text"] or len(r["text"]) < 40_000 else simhash.fingerprint(r["text"]) for r in rows]
        want = sorted(map(str, zip([r["doc_id"] for r in rows], [f"{f:016x}" for f in fps], brute_components(fps, [r["doc_id"] for r in rows], 3))))
        assert sorted(map(str, map(tuple, simhash.near_duplicates(table).collect()))) == want
    assert simhash.near_duplicates(none).count() == 0
    assert brute_fingerprint(lorem(9, 400)) == simhash.fingerprint(lorem(9, 400))


@pytest.mark.parametrize(("radius", "largest"), [(3, 4096), (3, 5), (7, 6)])
def test_links_lose_no_pair(spark, monkeypatch, radius, largest):
    monkeypatch.setattr(simhash, "LARGEST", largest)
    monkeypatch.setattr(simhash, "SMALL", 4)
    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = list({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius))) for c in centres for _ in range(25)} | {r.getrandbits(64) for _ in range(40)})
    found = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), radius)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    want = brute_components(fps, fps, radius)
    groups = lambda keys: sorted(sorted(f for f, k in zip(fps, keys) if k == x) for x in set(keys))
    assert groups([roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]) == groups(want)


def test_near_duplicate_filter_keeps_one_of_each(odd, none):
    kept = simhash.kept(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and 8 in ids
    assert simhash.kept(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_on_held_out_rows(spark, docs, odd, none):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = language.identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 8)} == {"und"}
    assert language.identify(none).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]
    assert language.kept(odd, None, 0.3).columns == odd.columns and language.kept(odd, None, 0.3).count() == 11 - 1


def test_a_class_that_has_only_long_texts_is_learnt_too(spark):
    rows = [(i, lorem(i, 40), "short") for i in range(60)] + [(100 + i, "ξ ψω " * 4_000, "long") for i in range(4)] + [(200, None, "short"), (201, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs, held_out=None)).collect()}
    assert all(got[i] == ("long" if 100 <= i < 200 else "short") for i in got if i < 200)
    some = ngrams.sampled(docs, docs.select("doc_id", "lang"), "lang", 200, 8_000, 4_000)
    assert max(len(t) for _, t, _ in some) <= 8_000 and {x for _, _, x in some} == {"short", "long"}
    assert {x for _, _, x in ngrams.sampled(docs, docs.select("doc_id", "lang"), "lang", 200, 8_000, 1)} <= {"short"}


def test_toxicity_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("needs the larger tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.classify(docs.join(labels, "doc_id", "left_semi"), labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 100 and sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_toxicity_on_planted_words(spark, odd, none):
    r = random.Random(4)
    texts = [(i, lorem(1000 + i, r.randint(20, 200)), int(i % 4 == 0)) for i in range(400)]
    texts = [(i, t if not y else t + " " + " ".join(r.choices(["zworgle", "quibnak", "vexmoor"], k=3)), y) for i, t, y in texts]
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    rows = toxicity.classify(table, table.select("doc_id", "toxic")).join(table, "doc_id").collect()
    held = [x for x in rows if x["held_out"]]
    assert held and all(x["predicted"] == x["toxic"] for x in held)
    got = toxicity.classify(odd, table.select("doc_id", "toxic")).collect()
    assert len(got) == odd.count() and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.classify(none, table.select("doc_id", "toxic")).count() == 0
    unlabelled = toxicity.classify(odd, table.filter("false").select("doc_id", "toxic")).agg(F.max("score")).first()[0]
    assert unlabelled < 1e-9


def test_sharding_is_even_and_gapless(docs, odd, none):
    for table, n in ((docs, 24), (odd, 3), (docs, 1)):
        rows = sharding.shard(table, n).collect()
        assert len(rows) == table.count()
        sizes, slots = [0] * n, [[] for _ in range(n)]
        for r in rows:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        largest = max(r["size"] for r in rows)
        assert all(abs(s - sum(sizes) / n) <= largest + 0.03 * sum(sizes) / n for s in sizes)
        assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sharding.shard(none).count() == 0


def test_sharding_splits_a_hot_group_and_keeps_small_ones(spark):
    rows = [(i, "hot copy of one text") for i in range(3000)] + [(10_000 + i, lorem(i // 3, 30)) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert per.max() - per.min() < 0.03 * per.mean()
    split = got.groupby("text_crc32")["shard"].nunique()
    assert (split > 1).sum() <= 8


def test_sharding_splits_along_metadata(spark):
    """Ranges of sources and languages: a shard holds few of their combinations; copies with other metadata stay together."""
    r = random.Random(3)
    rows = [(i, lorem(i, 40), r.choice(["de", "en", "fr"]), f"src{r.randrange(20):02d}") for i in range(3000)]
    rows += [(5000 + i, lorem(9_999, 40), ["de", "fr"][i % 2], f"src{i:02d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    got = sharding.shard(docs, 8).join(docs, "doc_id").toPandas()
    assert got.groupby("shard").apply(lambda g: len(set(zip(g["lang"], g["source"])))).max() <= 25  # of 60
    assert got[got["doc_id"] >= 5000]["shard"].nunique() == 1
    assert sharding.shard(docs.drop("n_chars"), 8).count() == len(rows)


def test_urls_are_judged_on_hosts_not_seen():
    r = random.Random(6)
    rows = [(f"http://{'win-bet' if y else 'news'}{r.randrange(200)}.example.{r.choice(['com', 'org'])}/{'9' * r.randint(4, 9) if y else 'about/us'}{i}{'?a=1&b=2&c=3' if y else ''}", y) for i in range(2000) for y in [int(r.random() < 0.4)]]
    found = urls.held_out(rows)
    assert found["urls"] > 200 and found["precision"] > 0.95 and found["recall"] > 0.95
    coin = [(f"http://h{i}.s{i}.test/x", r.randrange(2)) for i in range(2000)]  # suffixes of one row each say nothing
    assert 0.35 < urls.held_out(coin)["right"] < 0.65
    model = urls.learn(coin)
    assert np.mean((model.score([u for u, _ in coin]) >= 0.5) == np.array([k for _, k in coin])) < 0.8
    assert urls.held_out([])["urls"] == 0 and urls.learn([]).score(["http://x/"])[0] == 0.5


def test_url_rules_and_trees(spark, sf_dir, none):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, "no scheme"), (9003, "HTTP://A.Example.NET/en/x?y=/de/"), (9004, "http://net"), (9005, "https://example.com/de/#a"), (9006, "http://notexample.com/de/a"), (9007, "ftp://x.org/fr/")], "page_id long, url string")
    both = pages.select("page_id", "url").union(extra)
    rows = {r["page_id"]: r for r in urls.judge(both, URL_RULES).collect()}
    for r in both.collect():
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])]
        hit = [x for x, _ in URL_RULES if (host == x.split("/", 1)[0] or host.endswith("." + x.split("/", 1)[0])) and path.startswith("/" + x.split("/", 1)[1])]
        got = rows[r["page_id"]]
        assert (got["host"], got["path"], got["rule"]) == (host, path, max(hit, key=len) if hit else None)
        assert got["verdict"] == (dict(URL_RULES)[got["rule"]] if hit else "block" if got["score"] >= 0.5 else "allow")
        assert (got["score"] is None) == bool(hit)
    assert urls.judge(extra.limit(0), URL_RULES).count() == 0
    train = [(f"http://shop{i}.test/{'9' * (i % 7)}{i}?a={i}&b={i}", 1) for i in range(300)] + [(f"http://word.test/about/us/{'abc' * (i % 5)}", 0) for i in range(300)]
    model = urls.learn(train)
    assert ((model.score([u for u, _ in train]) >= 0.5) == np.array([y for _, y in train])).all()


def test_transport_streams_round_trip(docs, odd, none):
    for n in (0, 1, 63, 64, 161, 162, 163, 169, 170, 171, 184, 16_383, 16_384, 16_385, 1_200_000):
        payload = os.urandom(n)
        got = transport.read(transport.write(payload))
        assert got.payload == payload and not got.errors and all(got.random_access) and got.pts == [i * transport.TICKS for i in range(len(got.pts))]
    for table in (docs, odd):
        rows = transport.media_columns(table).collect()
        texts = table.select("doc_id", "text").collect()
        want = []
        for r in texts:
            raw = (r["text"] or "").encode()
            p = raw + bytes(-len(raw) % 64 if raw else 64)
            want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows)
        assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] and not r["errors"] for r in rows)
    assert transport.media_columns(none).count() == 0


def test_transport_reader_reports_damage():
    payload = os.urandom(50_000)
    media = transport.write(payload)
    lost = media[: 188 * 20] + media[188 * 21 :]
    assert any("continuity" in e for e in transport.read(lost).errors)
    bad = bytearray(media)
    bad[10] ^= 1
    assert any("bad section" in e for e in transport.read(bytes(bad)).errors)
    assert transport.read(b"").errors == ["no elementary stream"]
    assert any("sync" in e for e in transport.read(b"\0" * 188 + media).errors)
    assert transport.seek(transport.read(media), transport.TICKS) == transport.UNIT


def test_transport_reader_takes_what_the_format_allows():
    payload = os.urandom(50_000)
    media = transport.write(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join([*packets[:20], packets[19], *packets[20:]])
    assert transport.read(twice).payload == payload and not transport.read(twice).errors
    thrice = b"".join([*packets[:20], packets[19], packets[19], *packets[20:]])
    assert any("continuity" in e for e in transport.read(thrice).errors)
    damaged = bytearray(packets[19])
    damaged[1] |= 0x80
    got = transport.read(b"".join([*packets[:19], bytes(damaged), *packets[19:]]))
    assert got.payload == payload and any("damaged" in e for e in got.errors)
    # a new counter that the flag announces
    at = next(i for i, p in enumerate(packets) if i > 5 and p[1] & 0x40 and p[3] & 0x20 and p[4] > 0)
    moved = [bytes([*p[:3], p[3] & 0xF0 | (p[3] + 5) % 16, *p[4:]]) if i >= at and p[1:3] != packets[0][1:3] else p for i, p in enumerate(packets)]
    assert any("continuity" in e for e in transport.read(b"".join(moved)).errors)
    moved[at] = bytes([*moved[at][:5], moved[at][5] | 0x80, *moved[at][6:]])
    assert transport.read(b"".join(moved)).payload == payload and not transport.read(b"".join(moved)).errors
    # a program map with a descriptor of 220 bytes, over two packets
    body = (0xE000 | transport.STREAM_PID).to_bytes(2, "big") + b"\xf0\xde" + b"\x80\xdc" + bytes(220) + bytes([6]) + (0xE000 | transport.STREAM_PID).to_bytes(2, "big") + b"\xf0\0"
    section = transport.section(2, transport.PROGRAM, body)
    head = lambda start, n: bytes([0x47, 0x40 * start | transport.MAP_PID >> 8, transport.MAP_PID & 0xFF, 0x10 | n])
    long = (head(1, 0) + b"\0" + section[:183]) + (head(0, 1) + section[183:]).ljust(188, b"\xff")
    got = transport.read(packets[0] + long + b"".join(packets[2:]))
    assert got.payload == payload and not got.errors
    features = {transport.feature(transport.read(transport.write(bytes(p)))) for p in (b"a" * 64, b"ab" * 32, bytes(64))}
    assert len(features) == 3


def test_rows_of_one_id_lose_what_repeats_in_their_own_text(spark):
    p, y = lorem(301, 60), lorem(302, 30)
    for rows, want in (
        ([(1, p), (2, y + " " + p), (2, "short text")], {(1, p), (2, y), (2, "short text")}),
        ([(1, p), (2, p), (2, "short text"), (2, p)], {(1, p), (2, ""), (2, "short text")}),
        ([(3, p), (3, p + " " + y)], {(3, p), (3, p + " " + y)}),
        ([(None, p), (1, p), (None, None)], {(None, p), (1, p), (None, None)}),
    ):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(r["doc_id"], r["text"] and r["text"].strip()) for r in substrings.deduplicated(table).collect()} == want
    assert [r["doc_id"] for r in substrings.repeats(table).collect()] == [1]
    assert substrings.without("a b", [(0, 1), (5, 9)]) == "b"


def test_lines_of_any_length_are_compared(spark):
    """Every line of five words or more that is alike (exact Jaccard of shingles) with a lesser document's is repeated;
    runs of at least 24 words are removed."""
    r = random.Random(12)
    lines = [lorem(400 + i, r.randint(1, 60)) for i in range(40)]
    texts = []
    for i in range(30):
        own = [r.choice(lines) if r.random() < 0.4 else lorem(2_000 + 50 * i + k, r.randint(1, 60)) for k in range(r.randint(1, 8))]
        texts.append([" ".join([*line.split()[:-1], "end"]) if len(line.split()) > 15 and r.random() < 0.3 else line for line in own])
    table = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in substrings.repeats(table).collect()}
    shingles = lambda line: {tuple(line.split()[k : k + 5]) for k in range(len(line.split()) - 4)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i, t in enumerate(texts):
        must, at = set(), 0
        for line in t:
            n, s = len(line.split()), shingles(line)
            if n >= 5 and any(alike(s, shingles(o)) for before in texts[:i] for o in before if len(o.split()) >= 5):
                must |= set(range(at, at + n))
            at += n
        marked = {k for c in ("spans", "short_spans") for s in got[i][c] for k in range(s["start"], s["stop"])}
        assert must <= marked and got[i]["repeated_words"] == len(marked)
        assert all(s["stop"] - s["start"] >= 24 for s in got[i]["spans"]) and all(s["stop"] - s["start"] < 24 for s in got[i]["short_spans"])
        assert got[i]["removed_words"] == sum(s["stop"] - s["start"] for s in got[i]["spans"])


def test_substrings_on_awkward_tables(odd, none):
    got = {r["doc_id"]: r for r in substrings.repeats(odd.withColumn("spans", F.lit(1)).withColumn("hash", F.lit("h"))).collect()}
    assert got[7]["removed_words"] >= 59_000 and got[7]["kept_in"] == [6] and got[6]["removed_words"] == 0  # very long copies
    assert substrings.repeats(odd.filter("text is null")).agg(F.max("repeated_words")).first()[0] == 0
    assert toxicity.kept(none, toxicity.learn([])).count() == 0 and language.kept(none, None, 0.3).count() == 0


def test_substrings_find_repeats_and_leave_the_rest(spark, none):
    passage, near = lorem(77, 55), lorem(78, 60)
    edited = near.split()
    edited[30] = "zzz"
    rows = [(1, lorem(1, 40) + " " + passage + " " + lorem(2, 30)), (2, lorem(3, 20) + "\n" + lorem(4, 10) + " " + passage), (3, lorem(5, 80) + "\n" + lorem(6, 90)), (4, near), (5, " ".join(edited) + "\n" + lorem(7, 12)), (6, None), (7, ""), (None, passage), (8, "w " * 500), (9, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in substrings.repeats(table).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[2]["removed_words"] >= 24 and got[2]["kept_in"] == [1] and got[5]["n_paragraphs"] == 1 and got[5]["kept_in"] == [4]
    assert all(got[i]["removed_words"] == 0 for i in (1, 3, 4, 6, 7, 8, 9))
    clean = {r["doc_id"]: r for r in substrings.deduplicated(table, "n_chars").collect()}
    assert passage in clean[1]["text"] and passage not in clean[2]["text"] and clean[5]["text"] == lorem(7, 12) and clean[3]["text"] == rows[2][1]
    assert all(r["text"] is None or len(r["text"]) == r["n_chars"] for r in clean.values())
    assert substrings.repeats(none).count() == 0 and substrings.deduplicated(none).columns == none.columns


def test_every_long_shared_run_shares_a_window():
    r = np.random.default_rng(3)
    for _ in range(200):
        shared = r.integers(0, 1 << 63, substrings.WINDOW + substrings.STRIDE - 1, dtype=np.uint64)
        docs = [substrings.runs(np.concatenate([r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64), shared, r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64)]), substrings.WINDOW) for _ in range(2)]
        a, b = (set(d[substrings.chosen(d)].tolist()) for d in docs)
        assert a & b


def test_wrapped_passages_with_a_changed_word_are_compared(spark):
    def wrapped(words, *sizes):
        lines, at = [], 0
        for n in sizes:
            lines.append(" ".join(words[at : at + n]))
            at += n
        assert at == len(words)
        return "\n".join(lines)

    def edited(words):
        return [*words[:26], "changed", *words[27:]]

    a, b, c = (lorem(600 + i, n).split() for i, n in enumerate((52, 70, 54)))
    rows = [(1, lorem(610, 9) + "\n" + wrapped(a, 13, 13, 13, 13) + "\n\n" + lorem(611, 60)), (2, lorem(612, 14) + "\n" + lorem(613, 20) + "\n" + wrapped(edited(a), 13, 13, 13, 13) + "\n" + lorem(614, 8)),
            (3, wrapped(b, 10, 10, 10, 10, 10, 10, 9, 1)), (4, wrapped(edited(b), 10, 10, 10, 10, 10, 10, 9, 1)), (5, " ".join(c)), (6, lorem(615, 12) + "\n" + wrapped(edited(c), 20, 20, 14)),
            (7, "\n".join(lorem(620 + i, 3) for i in range(40))), (8, "\n".join(lorem(620 + i, 3) for i in range(18)) + "\n" + "\n".join(lorem(680 + i, 3) for i in range(40)))]
    clean = {x["doc_id"]: x["text"].split() for x in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t.split() for i, t in rows}
    assert all(clean[i] == texts[i] for i in (1, 3, 5, 7))
    assert clean[2] == (lorem(612, 14) + " " + lorem(613, 20) + " " + lorem(614, 8)).split() and clean[4] == [] and clean[6] == lorem(615, 12).split()
    assert clean[8] == texts[8][len(texts[8]) - len(clean[8]) :] and 114 <= len(clean[8]) <= 120  # small lines do not chain


def test_shared_runs_inside_lines_go_up_to_their_ends(spark):
    """Words of runs of 39 that a document of a lesser id has too are removed, and none that no run of 24 covers."""
    r = random.Random(4)
    passages = [lorem(700 + i, n) for i, n in enumerate((39, 51, 51, 60, 75, 120))]
    texts = []
    for i in range(60):
        p = r.choice(passages).split()
        if r.random() < 0.4:  # only a part of it, so that runs end elsewhere in other documents
            p = p[r.randrange(len(p) - 30) :]
        texts.append(" ".join([lorem(800 + i, r.randint(0, 40)), *p, lorem(900 + i, r.randint(0, 40)), *(r.choice(passages).split() if r.random() < 0.3 else [])]).split())
    got = {x["doc_id"]: x for x in substrings.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        covered = {}
        for n in (24, 39):
            seen = {tuple(o[k : k + n]) for o in texts[:i] for k in range(len(o) - n + 1)}
            covered[n] = {k + j for k in range(len(t) - n + 1) if tuple(t[k : k + n]) in seen for j in range(n)}
        removed = {k for s in got[i]["spans"] for k in range(s["start"], s["stop"])}
        assert covered[39] <= removed <= covered[24]
        assert got[i]["removed_words"] == len(removed)


def test_merged_lists_are_those_of_merged():
    r = random.Random(2)
    lists = [[(a, a + r.randint(1, 9)) for a in (r.randrange(60) for _ in range(r.randint(0, 12)))] for _ in range(300)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    array = pa.array([[{"start": a, "stop": b} for a, b in x] for x in lists], kind)
    for some, theirs in ((array, lists), (array[7:90], lists[7:90]), (array[:0], [])):
        assert [[(s["start"], s["stop"]) for s in x] for x in substrings.merged_lists(some).to_pylist()] == [substrings.merged(x) for x in theirs]


def test_paragraph_links_are_those_of_exact_jaccard(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LARGEST", 6)
    r = random.Random(8)
    base = [lorem(200 + i, 70).split() for i in range(4)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(70)] = f"q{r.randrange(99)}"
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(66)} for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    taken = substrings.parts(docs).filter("kind = 1")
    paragraphs = taken.groupBy("hash").agg(F.min("doc_id").alias("owner"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(substrings.BANDS)])
    roots = {x["node"]: x["root"] for x in components.components(substrings.paragraph_links(docs, paragraphs, 0.8)).collect()}
    of = {x["doc_id"]: x["hash"] for x in taken.collect()}
    found = [roots.get(of[i], of[i]) for i in range(len(texts))]
    groups = lambda keys: sorted(sorted(i for i, k in enumerate(keys) if k == x) for x in set(keys))
    assert groups(found) == groups(label)


def test_fingerprints_and_next_documents(docs, odd, none):
    for table in (docs, docs.limit(1)):
        rows = {r["doc_id"]: r for r in fingerprints.compare(table).collect()}
        own = sorted(table.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
        for i, r in enumerate(own):
            text, after = r["text"], own[(i + 1) % len(own)]["text"]
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            a, b, c = (fingerprints.fingerprint(x) for x in (text, edited, after))
            got = rows[r["doc_id"]]
            assert (got["n_chars"], got["edited_sha256"], got["fingerprint"], got["edited_fingerprint"]) == (n, hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}")
            assert got["near_edited"] == fingerprints.likeness(a, b) and got["near_next"] == fingerprints.likeness(a, c)
    assert fingerprints.compare(odd).count() == odd.count() and fingerprints.compare(none).count() == 0


def brute_votes(text: str) -> list[float]:
    """The votes of op10's fingerprint, bit by bit: each word by the root of its count and its length, short ones less."""
    votes, words = [0.0] * 64, text.lower().split()
    for w in set(words):
        weight, h = words.count(w) ** 0.5 * (0.25 if len(w) <= 3 else min(len(w), 32)), xxhash.xxh64_intdigest(w.encode())
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return votes


def test_fingerprints_and_groups_equal_brute_force(docs, odd):
    for table in (docs.limit(60), odd.filter("text is null or length(text) < 3000").filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r["doc_id"]: r for r in fingerprints.compare(table).collect()}
        texts = {r["doc_id"]: r["text"] or "" for r in table.select("doc_id", "text").collect()}
        assert set(rows) == set(texts)
        for i, text in texts.items():
            fp = int(rows[i]["fingerprint"], 16)
            for b, vote in enumerate(brute_votes(text)):
                if abs(vote) > 1e-3:  # sums are taken in single precision
                    assert (fp >> b & 1) == (vote > 0)
        ids = sorted(texts)
        assert [rows[i]["group_id"] for i in ids] == brute_components([int(rows[i]["fingerprint"], 16) for i in ids], ids, 3)


def test_language_kernels_equal_sets_of_n_grams():
    def grams(text: str) -> set[str]:
        text = " " + " ".join(text.lower().split()) + " "
        return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}

    rows = [(i, lorem(4_000 + i, 12), "ab"[i % 2]) for i in range(12)]
    model = language.learn(rows)
    landmarks = [r for k in "ab" for r in rows if r[2] == k]  # few rows: all are landmarks
    got = model.kernels([ngrams.bins(t, 1, 4) for _, t, _ in rows])
    for i, (_, text, _) in enumerate(rows):
        own = grams(text)
        for j, (_, other, _) in enumerate(landmarks):
            want = len(own & grams(other)) / (len(own) * len(grams(other))) ** 0.5
            assert abs(got[i, j] - want) < 0.01  # bins of a hash: few n-grams share one
    assert np.isclose([got[i, landmarks.index(r)] for i, r in enumerate(rows)], 1, atol=1e-5).all()


def test_fingerprint_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rows = [(i * 10**17 - 5 * 10**18, lorem(i, 12)) for i in range(100)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    own = rows[::-1]
    for i, (d, text) in enumerate(own):
        n, after = len(text), own[(i + 1) % 100][1]
        assert got[d] == hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest()


def test_search_finds_all_within_the_radius(spark):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(200)]
    queries = [f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for f in fps[:40]]
    frame = lambda xs: spark.createDataFrame([(simhash.signed(x),) for x in set(xs)], "fp long")
    got = {(x["query"], x["fp"], x["distance"]) for x in fingerprints.search(frame(queries), frame(fps), 3).collect()}
    assert got == {(simhash.signed(q), simhash.signed(f), (q ^ f).bit_count()) for q in queries for f in fps if (q ^ f).bit_count() <= 3}
