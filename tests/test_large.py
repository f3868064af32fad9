"""What only shows on larger tables: ties, files of one row group, groups that are wide, work that lands in few tasks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillmark import plans
from quillmark.functions import text as T
from quillmark.operators import architecture, chunking, facts, layout, retrieval, similar, workspaces, yamls
from quillmark.plans import tabular
from quillmark.sources import pdf


def test_ties_of_first_wins_go_to_the_first_in_the_file(spark, tmp_path):
    """Spark reads the larger file first; the rows of the smaller one come first by name."""
    line = "l_orderkey long, l_linenumber int, l_returnflag string, l_partkey long"
    first, second = [(k, 1, "A", k) for k in range(20)], [(k % 400, 1, "A", 1_000 + k) for k in range(4_000)]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, line).coalesce(1).write.parquet(str(tmp_path / "made" / name))
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        next((tmp_path / "made" / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = {r["l_orderkey"]: r["l_partkey"] for r in plans.queries()["first_wins"](spark, str(tmp_path)).collect()}
    assert got == {k: k if k < 20 else 1_000 + k for k in range(400)}


def tasks(rows) -> int:
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_the_files_of_a_small_table_are_read_by_many_tasks(spark):
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("red blue").alias("p_name"), F.lit("TIN").alias("p_type")).coalesce(1)
    rows = pdf.read(tabular.page_files(parts))
    assert tasks(rows) > 8 and tasks(layout.lines(pdf.words(rows))) > 8


@pytest.mark.parametrize("made", [facts.extract, yamls.nodes, architecture.matches])
def test_many_small_sources_are_parsed_by_many_tasks(spark, made):
    text = {facts.extract: "def f(): pass", yamls.nodes: "a: 1", architecture.matches: "app = FastAPI()"}[made]
    files = spark.range(200).select(F.format_string("src/f%d.py", "id").alias("path"), F.lit(text).alias("content")).coalesce(1)
    assert tasks(made(files)) > 8


def test_totals_of_scopes_equal_the_lists(spark):
    """Also for a workspace so wide that a row for each pair of member and project could not be made."""
    users, many = 40_000, 40_000
    chosen = spark.range(users).select(F.col("id").alias("user_id"), F.lit("d").alias("department_id"), (F.col("id") % 2).alias("workspace_id"))
    projects = spark.range(many).select(F.col("id").alias("project_id"), (F.col("id") % 3).alias("workspace_id"), F.when(F.col("id") % 5 > 0, "workspace").when(F.col("id") % 2 == 0, "private").alias("access_scope"), (F.col("id") % 50).alias("owner_user_id"), F.when(F.col("id") % 7 == 0, "deleted").otherwise("active").alias("status"))
    grants = spark.range(2_000).select((F.col("id") * 5 % 1_000).alias("project_id"), (F.col("id") % 60).alias("user_id"), F.when(F.col("id") % 4 == 0, "disabled").otherwise("active").alias("status"))
    said = workspaces.scope_totals(chosen, projects, grants)
    assert said.count() == users and said.agg(F.sum("n_projects")).first()[0] > 100_000_000
    few = lambda df, c, n: df.filter(F.col(c) < n)
    args = few(chosen, "user_id", 70), few(projects, "project_id", 1_000), grants
    lists = {r["user_id"]: r["allowed_project_ids"] for r in workspaces.scopes(*args).collect()}
    got = {r["user_id"]: (r["n_projects"], r["ids"]) for r in workspaces.scope_totals(*args).collect()}
    assert got == {k: (len(v), sum(v)) for k, v in lists.items()}


@pytest.mark.parametrize("bits", [12, 1])
def test_intervals_that_are_open_all_along_are_swept_by_many_tasks(spark, monkeypatch, bits):
    monkeypatch.setattr(facts, "TILE_BITS", bits)
    r = random.Random(bits)
    spans = [(k, s := r.randrange(-50, 60_000), s + r.choice([-1, 0, 3, 40, 700, 9_000, 10**12])) for k in range(400)]
    spots = [(1_000 + k, r.randrange(-60, 70_000)) for k in range(300)]
    intervals = spark.createDataFrame([("f", *x) for x in spans], "path string, symbol_id long, start_line long, end_line long")
    points = spark.createDataFrame([("f", *x) for x in spots], "path string, point_id long, line long")
    first = facts.around(points, intervals, ["path"], (F.col("start_line"), F.lit(0)))
    within = lambda line: [(k, s, e) for k, s, e in spans if s <= line <= e]
    assert {x["point_id"]: x["symbol_id"] for x in first.collect()} == {k: min(((s, i) for i, s, _ in within(line)), default=(0, None))[1] for k, line in spots}
    narrow = facts.innermost(points, intervals, ["path"])
    assert {x["point_id"]: x["symbol_id"] for x in narrow.collect()} == {k: min(((e - s, -s, i) for i, s, e in within(line)), default=(0, 0, None))[2] for k, line in spots}


class Caught:
    """Stands for a table: keeps the function that would run on its batches."""

    schema = {"doc_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})()}

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_pieces_of_a_large_batch_leave_in_small_ones(spark):
    caught = chunking.exploded(Caught(), lambda text: [(w, "") for w in chunking.windows(text, 50, 0)], ["doc_id"], ["text"])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1_000)), "text": ["some words " * 20] * 1_000})
    made = list(caught.run(iter([batch])))
    assert max(len(set(b.column("doc_id").to_pylist())) for b in made) <= 128
    assert sorted({i for b in made for i in b.column("doc_id").to_pylist()}) == list(range(1_000))


def test_scores_of_many_queries_are_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 5_000)
    r = np.random.default_rng(1)
    v = r.normal(size=(1_000, 8))
    caught = retrieval._best_of_batches(Caught(), [(i, list(q)) for i, q in enumerate(v[:40])], 3)
    widest = []
    top = retrieval._top
    monkeypatch.setattr(retrieval, "_top", lambda s, ids, k: widest.append(s.base.size) or top(s, ids, k))
    found = next(caught.run(iter([pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(v.tolist())], ["a", "b"])]))).to_pydict()
    assert max(widest) <= 5_000
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = np.argsort(-(unit[:40] @ unit.T), axis=1)[:, :3]
    assert found["query_id"] == [i for i in range(40) for _ in range(3)] and found["vec_id"] == best.ravel().tolist()


def test_the_language_found_decides_what_is_packed_together(spark, tmp_path):
    corpus_pipeline, lorem = pytest.importorskip("corpus_pipeline"), lambda k, letters: " ".join("".join(random.Random(f"{k} {i}").choices(letters, k=6)) for i in range(60))
    own = {"x": "abcdefgh", "y": "opqrstuv"}
    rows = [(k, lorem(k, own["xy"[k % 2]]), None if k % 5 == 0 else "xy"[k % 2], "s", 400) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language_stage(spark, docs, "")
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {k: "xy"[k % 2] for k in range(80)}
    sequences = corpus_pipeline.packing_stage(spark, found, "").collect()
    by_sequence = {}
    for r in sequences:
        by_sequence.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert sorted(by_sequence) == list(range(len(by_sequence))) and all(len(v) == 1 for v in by_sequence.values())
    assert {r["doc_id"] for r in sequences} == set(range(80))


def test_lines_are_dealt_before_their_trigrams_are_made(spark, monkeypatch):
    """A line's only trigram says here which task made it."""
    monkeypatch.setattr(similar, "trigrams", lambda c: F.array(F.when(F.startswith(c, F.lit("p")), c).otherwise(F.concat(F.lit("p"), F.spark_partition_id().cast("string")))))
    tasks_ = spark.range(64).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("left_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("content"))
    lines = spark.range(200).select(F.col("id").alias("right_id"), F.lit("some").alias("content")).coalesce(1)
    got = similar.similar(tasks_, lines, 0.5).collect()
    assert len(got) == 200 and len({r["left_id"] for r in got}) > 8


def test_long_lines_are_left_by_their_start(spark, monkeypatch):
    """All trigrams of a long line are made only if its start has as few as a similar one could have."""
    whole = lambda c: F.when((F.char_length(c) > 1_000) & F.contains(c, F.lit("0")), F.raise_error("a long line's trigrams").cast("array<string>")).otherwise(T.trigrams(c))
    for module in (similar, retrieval):
        monkeypatch.setattr(module, "trigrams", whole)
    prose, same = " ".join(f"w{i}o{i * 7}r" for i in range(400)), "abc " * 400
    lines = spark.createDataFrame([(1, prose), (2, same), (3, "abc"), (4, None), (5, "")], "right_id long, content string").coalesce(1)
    terms = spark.createDataFrame([("abc", "abc")], "left_id string, content string")
    assert {(r[0], r[1], r[2]) for r in similar.similar(terms, lines, 0.3).collect()} == {("abc", 2, 1.0), ("abc", 3, 1.0)}
    assert [tuple(r) for r in retrieval.keyword_recall(lines, ["abc"], 9, "right_id").collect()] == [(2, 1.0), (3, 1.0)]


def test_trigrams_and_their_bound_equal_the_words_own(spark):
    rng = random.Random(3)
    some = "aAbßΣσʼʼ\U0001d4d0\U00020000\U0001F600 .,\u0301İ\x85_9½Ⅷ\r\t\x00한"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(90))) for _ in range(1_000)]
    rows = spark.createDataFrame([(x,) for x in [*texts, "", "a", ".", None]], "x string")
    words = F.regexp_extract_all(F.lower("x"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    assert rows.filter(~T.trigrams(F.col("x")).eqNullSafe(F.array_distinct(F.flatten(F.transform(words, each))))).count() == 0
    assert rows.filter((F.size(T.trigrams(F.col("x"))) <= 20) & ~T.may_have_few_trigrams(F.col("x"), 20)).count() == 0


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_similar_texts_equal_all_pairs_sent_or_dealt(spark, monkeypatch, sent):
    monkeypatch.setattr(similar, "SENT", sent)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "then", "thention", "ciónar", "anche", "x", "blend"]) for _ in range(rng.randrange(1, 5)))
    left, right = [(i, text()) for i in range(60)], [(i, text()) for i in range(90)]
    grams = lambda x: {f"  {w} "[i : i + 3] for w in x.split() for i in range(len(w) + 1)}
    want = {(i, j): len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for i, x in left for j, y in right}
    got = {(r[0], r[1]): r[2] for r in similar.similar(spark.createDataFrame(left, "left_id long, content string"), spark.createDataFrame(right, "right_id long, content string"), 0.3).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.3}


def test_what_passes_on_is_merged_by_many_tasks(spark):
    """Grants and memberships against a loop over the rows; rows of a null key stay as they are and receive nothing."""
    rng = random.Random(5)
    keys = [(p, u) for p in range(40) for u in range(50) if rng.random() < 0.6] + [(None, 0), (None, 10)]
    rows = [(p, u, rng.choice(workspaces.PERMISSIONS), rng.choice(["active", "disabled"])) for p, u in keys]
    to, rank = {u: u + 1 for u in range(0, 50, 10)}, workspaces.PERMISSIONS.index
    passed: dict[tuple, list[str]] = {}
    for p, u, value, status in rows:
        if status == "active" and u in to:
            passed.setdefault((p, to[u]), []).append(value)
    want = [(p, u, value, "disabled" if u in to else status) for p, u, value, status in rows if p is None or (p, u) not in passed]
    held = {(p, u): [value] for p, u, value, _ in rows if p is not None}
    want += [(*k, max(values + held.get(k, []), key=rank), "active") for k, values in passed.items()]
    grants = spark.createDataFrame(rows, "project_id long, user_id long, permission string, status string").coalesce(1)
    handovers = spark.createDataFrame(list(to.items()), "source_id long, target_id long")
    members = grants.filter("project_id is not null").select(F.col("project_id").alias("workspace_id"), "user_id", F.element_at(F.array(*map(F.lit, workspaces.ROLES)), F.expr("1 + array_position(array('read', 'write', 'admin'), permission)").cast("int")).alias("role"), "status", F.col("user_id").alias("joined_at"))
    spaces = spark.createDataFrame([(3, 0, "team", "active"), (4, 7, "team", "active"), (5, 10, "team", "closed")], "workspace_id long, owner_user_id long, workspace_type string, status string")
    after = workspaces.handed_over(members, spaces, {}, grants, handovers)
    assert sorted(map(tuple, after["grants"].collect()), key=str) == sorted(want, key=str)
    got = {(r["workspace_id"], r["user_id"]): r for r in after["memberships"].collect()}
    role = {"read": "editor", "write": "admin", "admin": "owner"}
    assert {k: (r["role"], r["status"]) for k, r in got.items()} == {(p, u): (role[v], s) for p, u, v, s in want if p is not None} | {(3, 1): ("owner", "active")}
    assert all(r["joined_at"] == (min(u - 1, u) if (p, u - 1) in keys and r["status"] == "active" and (p, u) in passed else u) for (p, u), r in got.items() if (p, u) in held and (p, u) != (3, 1))
    assert tasks(after["grants"]) > 8 and tasks(after["memberships"]) > 8


def test_links_are_made_by_many_tasks(spark):
    """Against a loop over all pairs; ids that occur twice, values that are null or empty, and keys that many facts share."""
    rng = random.Random(6)
    kinds = ["client_initialization", "downstream_call", "endpoint_config", "downstream_grpc", "kafka_topic_config", "kafka_topic_producer", "kafka_topic_consumer", "mongo_collection", "component"]
    rows = [(rng.randrange(250), rng.choice(kinds), rng.choice(["cart", "", "orders", "stock"]), rng.choice(["cart", None, "", " Orders"]), rng.choice(["a.py", "b.yaml", None])) for _ in range(300)]

    def linked(a, b):
        (_, k, name, value, path), (_, j, name_, value_, path_) = a, b
        config, config_ = path == "b.yaml", path_ == "b.yaml"
        called = lambda n, v: (n if v is None or v == "" else v).strip().lower()
        if k == "client_initialization" and j == "downstream_call" and None not in (path, value) and (path, value) == (path_, value_):
            yield "client_invokes", 0.96
        if k in ("endpoint_config", "downstream_grpc") and config and j == "client_initialization" and name == name_ != "":
            yield "configures_client", 0.9
        if j in facts.RESOURCES.get(k, []) and config and path_ is not None and not config_ and called(name, value) == called(name_, value_) != "":
            yield "configures_usage", 0.98

    want = {(a[0], b[0], *x) for a in rows for b in rows if a[0] != b[0] for x in linked(a, b)}
    made = facts.links(spark.createDataFrame(rows, "fact_id long, fact_type string, name string, value string, path string").coalesce(1))
    got = [tuple(r) for r in made.collect()]
    assert sorted(got) == sorted(want) and {x[2] for x in want} == {"client_invokes", "configures_client", "configures_usage"}
    assert tasks(made) > 8
