"""Rules that SQL does not express, against independent loops and literal cases."""

from __future__ import annotations

import uuid

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, catalog, chunking, controller, facts, graph, layout, protocol, retrieval
from quillmark.plans import code
from quillmark.plans.chunks import MARKDOWN, SOURCES
from quillmark.sources import files
from quillmark.streaming import limiters


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("x \n"), max_size=120), st.integers(2, 30), st.integers(0, 12))
def test_windows_cover_the_text_and_keep_their_size(kinds, size, overlap):
    whole = "".join(chr(0x4E00 + i) if k == "x" else k for i, k in enumerate(kinds)).strip()  # each letter occurs once
    pieces, end = chunking.windows(whole, size, overlap), 0
    for p in pieces:
        first = next((c for c in p if c.strip()), None)
        at = end if first is None else whole.index(first) - p.index(first)
        assert 0 < len(p) <= size and at <= end and whole[at : at + len(p)] == p or first is None
        end = max(end, at + len(p)) if first is not None else end + len(p)
    letters = {c for p in pieces for c in p if c.strip()}
    assert letters == {c for c in whole if c.strip()}


def test_markdown_keeps_fences_and_repeats_table_heads():
    pieces = chunking.markdown(MARKDOWN)
    assert [r for _, r in pieces] == ["Guide", "Guide > Table", "Guide > Table#table-1", "Guide > Table", "Next"]
    assert pieces[2][0].endswith("表格行：name：b；size：2；列3：extra")
    many = chunking.table_text(["a"], [[str(i)] for i in range(50)], 60)
    assert len(many) > 1 and all(m.startswith("表格列：a\n") for m in many)
    assert chunking.table_text(["a"], [], 60) == []


def test_python_split_loses_no_line():
    for path, source in SOURCES:
        pieces = chunking.by_suffix(source, path.rpartition(".")[2])
        for line in filter(None, map(str.strip, source.splitlines())):
            if line != "}":
                assert any(line in p for p, _ in pieces), line
    assert chunking.python("def broken(:") == [("def broken(:", "code")]
    assert chunking.python("x = 1\ny = 2") == [("x = 1\ny = 2", "module")]


def test_expressions_equal_the_library(spark):
    row = spark.createDataFrame([(" Ａb@X.org ", "a/../b", "https://github.com/Own/repo.git", "a  B")], "e string, p string, u string, n string").select(
        T.email_key(F.col("e")).alias("e"), T.upload_path(F.col("p")).alias("p"), T.repository_url(F.col("u")).alias("u"), T.name_key(F.col("n")).alias("n"), T.uuid5(str(uuid.NAMESPACE_URL), F.lit("x")).alias("id"), T.lock_key(F.lit("k")).alias("k"),
    ).first()
    assert row["e"] == "ab@x.org" and row["p"] is None and row["n"] == "a b"
    assert row["u"]["url"] == "https://github.com/Own/repo.git" and row["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))
    import hashlib

    assert row["k"] == int.from_bytes(hashlib.sha256(b"k").digest()[:8], "big", signed=True)


def test_expand_equals_a_loop(spark, sf_dir):
    import random

    random.seed(3)
    hits, parents = [], {}
    for q in range(40):
        for r in range(1, 12):
            p = random.choice([None, random.randrange(5) + 10 * q])
            if p is not None:
                parents[p] = "p" * random.randrange(0, 90)
            hits.append((q, r, 1000 * q + r, p, "c" * random.randrange(0, 60)))
    got = retrieval.expand(spark.createDataFrame(hits, "query_id int, rank int, chunk_id int, parent_chunk_id int, content string"), spark.createDataFrame(list(parents.items()), "chunk_id int, content string"), 60).collect()
    tokens = lambda s: max(1, -(-len(s.strip()) // 2))
    want = []
    for q in range(40):
        seen, used = set(), 0
        for _, r, c, p, text in [h for h in hits if h[0] == q]:
            key = ("p", p) if p in parents else ("c", c)
            if key in seen:
                continue
            seen.add(key)
            left = 60 - used
            if left <= 0:
                break
            whole, level = (parents[p], "parent") if p in parents else (text, "child")
            if tokens(whole) > left:
                whole, level = (text, "child_fallback") if tokens(text) <= left else (text[: max(2, left * 2)], "child_truncated")
            used += tokens(whole)
            want.append((q, r, c, level, whole, tokens(whole)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_fusion_cap_and_visibility(spark):
    a = spark.createDataFrame([(i, i) for i in range(1, 9)], "doc_id long, rank int")
    fused = retrieval.fuse([a, a.filter("doc_id > 4")], "doc_id").withColumn("document", F.lit("d"))
    assert retrieval.diversify(fused, "document", "doc_id", 10).count() == 3
    rows = spark.createDataFrame([("workspace", None, None), ("personal", "u", None), ("department", None, "d"), ("personal", "v", None)], "scope_type string, owner_user_id string, owner_department_id string")
    assert rows.filter(retrieval.visible("u", None)).count() == 2 and rows.filter(retrieval.visible(None, None)).count() == 1
    assert rows.select(retrieval.rewrites(F.lit("how do the teams rotate keys?")).alias("r")).first()["r"][0] == "how do the teams rotate keys"


def test_code_facts(spark):
    found = facts.extract(spark.createDataFrame(SOURCES, "path string, content string"))
    names = {(r["path"], r["qualified_name"]) for r in facts.symbols(found).collect()}
    assert {("a/app.py", "Box.get"), ("a/main.go", "main"), ("a/ui.ts", "View"), ("a/broken.py", "file")} <= names
    calls = {(r["source"], r["relation_type"], r["target_ref"]) for r in facts.relations(found).collect()}
    assert {("Box.get", "calls", "os.path.join"), ("file", "imports", "x:y"), ("file", "parse_warning", "python_syntax_error")} <= calls
    configs = facts.config_facts(spark.createDataFrame(code.CONFIGS, "path string, content string")).collect()
    assert {"[REDACTED]"} == {r["value"] for r in configs if "TOKEN" in r["key_path"]}
    assert {"service", "dependency", "helm_value", "helm_template", "parse_error"} <= {r["fact_type"] for r in configs}


def test_trace_is_bounded_and_names_cycles(spark):
    edges = spark.createDataFrame([(1, 1, 2, "b", 0.9), (2, 2, 1, "a", 0.9), (3, 1, 3, "c", 0.5), (4, 2, 3, "c", 0.8), (5, 3, None, "lost", 0.8), (6, 3, 4, "d", 0.1)], "relation_id long, source_id long, target_id long, target_ref string, confidence double")
    t = graph.trace(edges, 1, 4, 3)
    kinds = {r["relation_id"]: r["kind"] for r in t.edges.collect()}
    assert kinds == {1: "tree", 2: "cycle", 3: "tree", 4: "known", 6: "over"} and t.truncated
    assert [r["target_ref"] for r in t.unresolved.collect()] == ["lost"]
    assert {r["symbol_id"] for r in graph.reach(edges, spark.createDataFrame([(1,)], "start_id long"), 4).collect()} == {1, 2, 3, 4}
    assert graph.neighbours(edges, 3).count() == 4


def test_controller_cases(spark):
    claims = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"]), (1, 3, ["a", "d"]), (1, 4, ["zz"]), (2, 1, ["x"])], "case_id int, ordinal int, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "a", 40), (1, "b", 40), (1, "c", 90), (1, "d", 10)], "case_id int, evidence_id string, length int")
    packed = {(r["case_id"], r["ordinal"]): r["taken"] for r in controller.pack_claims(claims, evidence, 120).collect()}
    assert packed == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (2, 1): False}
    assert [r["reason"] for r in sorted(controller.contract(spark.createDataFrame(CONTRACTS, "case_id int, answer string, claims array<struct<text: string, evidence_ids: array<string>>>, allowed array<string>")).collect(), key=lambda r: r["case_id"])] == ["validated", "unapproved_citation", "missing_required_citation", "claim_text_or_mapping_changed", "empty_answer_contract"]
    log = [
        (1, 1, "search", '{"q":"a"}', "a", 0, True, 1), (1, 2, "search", '{"q":"a"}', "a", 0, False, 1), (1, 3, "list_project_files", "{}", "", 0, True, 2), (1, 4, "list_project_files", '{"offset":0}', "", 0, True, 2),
        (1, 5, "list_project_files", '{"offset":50}', "", 50, False, 3), (1, 6, "search", '{"q":"b"}', "b", 0, False, 4), (1, 7, "search", '{"q":"c"}', "c", 0, True, 5), (2, 1, "search", '{"q":"a"}', "a", 0, True, 1),
    ]
    calls = spark.createDataFrame(log, "loop_id int, seq int, name string, arguments string, query string, page_offset int, progress boolean, round int")
    reasons = [r["reason"] for r in sorted(controller.admissions(calls).collect(), key=lambda r: (r["loop_id"], r["seq"]))]
    assert reasons == [None, "same_query_repeated", None, "project_files_already_inspected", None, None, "no_new_evidence", None]
    kept = controller.budget_prefix(spark.createDataFrame([(1, 1, 50), (1, 2, 90), (1, 3, 10)], "g int, o int, n int"), "g", "o", "n", 100, 60).collect()
    assert [r["kept"] for r in sorted(kept, key=lambda r: r["o"])] == [50, 50]


def test_layout_reads_columns_and_drops_headers(spark):
    words = spark.createDataFrame([(1, p, 600.0, 800.0, x, x + 40, t, t + 10, w) for p, x, t, w in WORDS], "doc_id int, page int, width double, height double, x0 double, x1 double, top double, bottom double, text string")
    pages = layout.page_text(layout.lines(words)).collect()
    assert all(p["two_columns"] and "Annual" not in p["text"] and p["text"].startswith(f"w{p['page']}1") for p in pages)
    assert layout.SAME_LINE == 3.0


def test_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([("p", "c1", 1), ("p", "c2", 2)], "project_id string, commit_hash string, v int")
    catalog.write_snapshot(rows, str(tmp_path / "t"))
    catalog.write_snapshot(spark.createDataFrame([("p", "c2", 3)], rows.schema), str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 3]
    old = spark.createDataFrame([("p", "n", "u", None)], "project_id string, name string, owner_user_id string, repository_key string")
    new = spark.createDataFrame([("p", "m", "v", "k"), ("q", "x", "w", None)], old.schema)
    got = {r["project_id"]: tuple(r)[1:] for r in catalog.upsert_projects(old, new).collect()}
    assert got == {"p": ("m", "u", "k"), "q": ("x", "w", None)}
    assert catalog.rebase_paths(spark.createDataFrame([("/a/b",), ("/ab",)], "path string"), "path", "/a", "/z").collect()[0][0] == "/z/b"
    members = spark.createDataFrame([("w1", "u", "active", 2), ("w2", "u", "active", 1), ("w3", "u", "left", 0)], "workspace_id string, user_id string, status string, joined_at int")
    assert access.member_workspace(members, "u").first()["workspace_id"] == "w2" and access.member_workspace(members, "u", default="w1").first()["workspace_id"] == "w1"
    assert access.member_workspace(members, "u", requested="w3").count() == 0


def test_file_sources(spark, tmp_path):
    for path, content in {"a/x.py": "def f():\n    return 1\n", "node_modules/y.js": "z", "conf/app.yaml": "a: 1\n", "b/z_pb2.py": "x", "README.md": "hi"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    found = files.tree(spark, str(tmp_path))
    assert [r["path"] for r in files.sources(found).collect()] == ["a/x.py"]
    assert {r["path"] for r in files.config_files(found).collect()} == {"conf/app.yaml"}
    inventory = {r["path"]: (r["role"], r["line_count"], r["parser_status"]) for r in files.inventory(found).collect()}
    assert inventory["a/x.py"] == ("source", 2, "parsed") and inventory["README.md"][0] == "documentation" and "node_modules/y.js" not in inventory
    lines = files.line_range(files.sources(found).select("path", "content"), 2, 2).collect()
    assert [r["text"] for r in lines] == ["    return 1"]
    with pytest.raises(Exception, match="content has changed"):
        files.line_range(files.sources(found), expected_hash="0").collect()
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "question": "q", "required_terms": ["x"]}\n\n{"id": "b", "should_refuse": true}\n')
    assert files.cases(spark, str(tmp_path / "cases.jsonl")).count() == 2


def test_limiters_table_and_stream_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    batch = {r["event_id"]: r["attempts"] for r in limiters.fixed_window_table(events, "event_type", "ts", "event_id", 4).collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = limiters.fixed_window_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts", 4)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["attempts"] for r in spark.table("limited").collect()} == batch
    kept = limiters.sliding_log_table(events, "event_type", "ts", "event_id", 2, 600.0).toPandas().sort_values(["ts", "event_id"])
    for _, own in kept[kept.admitted].groupby("event_type"):
        t = pd.to_datetime(own.ts).astype("int64").to_numpy()
        assert (t[2:] - t[:-2] >= 600 * 10**9 // (1 if t[0] > 10**17 else 1000)).all()


def test_knowledge_base_end_to_end(spark, tmp_path):
    from quillmark import api
    from quillmark.operators import providers

    texts = ["kafka topics belong to the platform team. " * 30, "redis keys expire after a day. " * 40, "secret plans of one person. " * 20]
    none = None
    rows = [(i, f"/d/{i}", T_hash(t), "w", "personal" if i == 2 else "workspace", "u9" if i == 2 else none, none, "u9", t, "rag", "active") for i, t in enumerate(texts)]
    schema = "document_id long, source_path string, content_hash string, workspace_id string, scope_type string, owner_user_id string, owner_department_id string, created_by_user_id string, text string, source_type string, status string"
    incoming = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], schema.replace("text string", "current_revision long"))
    found, chunks, revisions = api.ingest(empty, incoming)
    assert {r["change"] for r in found.collect()} == {"created"} and revisions.count() == 3
    chunks = chunks.cache()
    vector = providers.hashed_vectors(["kafka topics team"])[0].tolist()
    hits = api.search(chunks, incoming, api.Scope("w"), vector, "kafka topics team", ["rag"], 5)
    top = hits.orderBy("rank").collect()
    assert top[0]["document_id"] == 0 and all(r["document_id"] != 2 for r in top)
    seen = api.context(hits, chunks, "kafka topics team", 300, 3).collect()
    assert seen and sum(r["context_tokens"] for r in seen) <= 300
    assert api.ingest(incoming.withColumn("current_revision", F.lit(1).cast("long")), incoming)[1].count() == 0
    for path, content in code.PROJECT:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    tables = api.scan(spark, str(tmp_path), "p")
    kinds = {r["fact_type"] for r in tables["facts"].collect()}
    assert {"module", "http_api", "entrypoint", "rpc_method", "kafka_topic_producer", "client_initialization", "downstream_call", "endpoint_config"} <= kinds
    links = {r["relation_type"] for r in tables["links"].collect()}
    assert links == {"client_invokes", "configures_client", "configures_usage"}
    job = tables["facts"].filter("fact_type = 'background_job'").join(tables["symbols"].select("symbol_id", "qualified_name"), "symbol_id").first()
    assert job["qualified_name"] == "nightly" and "tests/test_x.py" not in {r["path"] for r in tables["facts"].collect()}


def T_hash(text: str) -> str:  # noqa: N802
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_protocol(spark):
    a = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "m map<string, string>").select(protocol.canonical_arguments(F.col("m")).alias("c")).distinct().collect()
    assert [r["c"] for r in a] == ['{"a":"2","b":"1"}']
    schema = "workspace_id string, normalized_email string, role string, token_hash string, expires_at int, accepted_at int, revoked_at int"
    old = spark.createDataFrame([("w", "a", "viewer", "1", 9, None, None), ("w", "a", "viewer", "0", 9, 5, None), ("w", "b", "viewer", "2", 9, None, None)], schema)
    new = protocol.upsert_invitations(old, spark.createDataFrame([("w", "a", "admin", "3", 9, None, None)], schema))
    assert sorted(r["token_hash"] for r in new.collect()) == ["0", "2", "3"]
    moved = protocol.transfer({"d": spark.createDataFrame([("u",), ("v",)], "owner string")}, "owner", "u", "w")
    assert sorted(r["owner"] for r in moved["d"].collect()) == ["v", "w"]


DECISIONS = [
    (1, '{"next_action": "retrieve_rag", "route": "rag", "queries": [" a ", "", "b", "c", "d"], "reason": "r"}'), (2, '```json\n{"next_action": "answer", "claims": [{"text": "t", "evidence_ids": ["E1"]}]}\n```'),
    (3, '{"next_action": "fly"}'), (4, '{"next_action": "query_code_wiki", "route": "rag"}'), (5, "not json"), (6, '{"next_action": "answer", "claims": [{"text": ""}]}'), (7, '{"next_action": "answer", "scope_mode": "all"}'),
]


def test_decisions_are_validated(spark):
    found = protocol.decisions(spark.createDataFrame(DECISIONS, "case_id int, answer string"), ["retrieve_rag", "query_code_wiki", "answer", "refuse"], ["rag", "wiki", "hybrid"]).collect()
    assert {r["case_id"]: r["problem"] for r in found} == {1: None, 2: None, 3: "unsupported_action", 4: "route_action_mismatch", 5: "not_an_object", 6: "bad_claim", 7: "unsupported_scope_mode"}
    assert {r["case_id"]: r["queries"] for r in found}[1] == ["a", "b", "c"]


CONTRACTS = [
    (1, "- Kafka is used [E1]\n- Redis too [E2]", [("Kafka is used", ["E1"]), ("Redis too", ["E2"])], ["E1", "E2"]),
    (2, "Kafka [E9]", [("Kafka", ["E1"])], ["E1"]), (3, "Kafka", [("Kafka", ["E1"])], ["E1"]), (4, "Other text [E1]", [("Kafka", ["E1"])], ["E1"]), (5, "", [("Kafka", ["E1"])], ["E1"]),
]
WORDS = [(page, 100.0 if i % 2 else 500.0, 50.0 + 60 * (i // 2), f"w{page}{i}") for page in (1, 2) for i in range(10)] + [(p, 200.0, 5.0, "Annual") for p in (1, 2)] + [(p, 260.0, 6.0, "Report") for p in (1, 2)] + [(p, 300.0, 780.0, str(p)) for p in (1, 2)]
