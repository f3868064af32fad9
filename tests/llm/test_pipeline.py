"""The pipeline keeps clean documents, drops what its stages reject, and packs what is left."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from tests.llm.test_ops import lorem


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r, passage, copy = random.Random(1), lorem(500, 60), lorem(501, 400)
    rows = [(i, lorem(i, 150), i % 4 == 0) for i in range(400)]
    rows = [(i, t + " " + " ".join(r.choices(["zworgle", "quibnak", "vexmoor"], k=4)) if toxic else t, toxic) for i, t, toxic in rows]
    rows += [(1001, lorem(11, 50) + " " + passage, False), (1002, passage + " " + lorem(12, 50), False), (1003, copy, False), (1004, copy, False), (1005, "12 34", False), (1006, None, False)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_keep_and_drop(spark, planted, tmp_path):
    path, rows = planted
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i, _, toxic in rows if not toxic and i < 400}
    assert kept[0] == clean | {1001, 1002, 1003, 1004, 1005, 1006}
    assert kept[1] == clean | {1001, 1002, 1003, 1004}
    assert kept[2] == clean | {1001, 1002, 1003}
    assert kept[3] == kept[2] == kept[4]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert sum(lorem(500, 60) in t for t in texts.values()) == 1 and all(texts[i] == t for i, t, _ in rows if i in clean)


def test_run_packs_the_same(spark, planted):
    assert corpus_pipeline.run(spark, planted[0]).select("doc_id").distinct().count() == 303


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicate_stage_decides_by_exact_jaccard(spark):
    """Copies of 400 words with words changed 5 apart or more: all from 0.8 on go, all below stay."""
    r, rows, gone, near = random.Random(7), [], set(), set()
    for i in range(160):
        words = lorem(9_000 + i, 400).split()
        edited = list(words)
        for at in r.sample(range(2, 78), 1 + i % 12):
            edited[5 * at] = f"edited{i}x{at}"
        a, b = shingles(" ".join(words)), shingles(" ".join(edited))
        alike = len(a & b) / len(a | b)
        rows += [(i, " ".join(words)), (1_000 + i, " ".join(edited))]
        if alike >= 0.8:
            gone.add(1_000 + i)
        if 0.8 <= alike < 0.9:
            near.add(1_000 + i)
    docs = spark.createDataFrame([*rows, (5_000, None), (5_001, " "), (None, lorem(9_000, 400)), (6_000, "one two"), (6_001, "One two"), (6_002, "one three")], "doc_id long, text string")
    kept = [x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    missed = (set(kept) - {None}) & gone
    assert len(near) >= 40 and len(missed) <= 1 and set(kept) - missed == {i for i, _ in rows} - gone | {None, 5_000, 6_000, 6_002}
    assert len(kept) == len(set(kept))


@pytest.mark.parametrize("languages", [1, 2, 3, 5])
def test_language_stage_rejects_what_no_learned_language_is(spark, languages):
    def other(seed: int, n: int, letters: str) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))

    letters = ["αβγδεζηθικλμ", "бвгджзиклмно", "אבגדהוזחטיכל", "acehijoquvwxyz", "ابتثجحخدذرزس"]
    rows = [(100 * k + i, other(100 * k + i, 60, letters[k]), f"l{k}") for k in range(languages) for i in range(30)]
    rows += [(9_000 + i, other(9_000 + i, 60, "ნოპჟრსტუფქღყ"), None) for i in range(5)]  # of no learned language
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {i for i, _, _ in rows if i < 9_000}


def test_stages_take_nulls_and_repeated_ids(spark, tmp_path):
    """Texts that are null, empty or equal, ids that are missing or repeated: no stage fails, clean texts stay."""
    clean = [lorem(7_000 + i, 80) for i in range(4)]
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, "", "xx", "s", 0), (2, clean[0], "xx", "s", 5), (2, clean[1], "xx", "s", 5), (2, clean[1], "xx", "s", 5), (None, clean[2], "xx", None, 5), (3, clean[3], "xx", "s", 5), (4, clean[3], "xx", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table, kept in ((rows, {clean[0], clean[1], clean[2], clean[3]}), ([r for r in rows if not r[1]], set()), ([], set())):
        path = str(tmp_path / str(len(table)))
        spark.createDataFrame(table, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, path).write.parquet(f"{path}/{k}")
            docs = spark.read.parquet(f"{path}/{k}")
        before = spark.read.parquet(f"{path}/3")
        texts = [r["text"] for r in before.select("text").collect()]
        assert {t for t in texts if t} <= kept and {clean[2], clean[3]} & kept <= set(texts) and texts.count(clean[3]) <= 1
        assert docs.count() == before.count()
