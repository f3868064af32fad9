"""The store's methods over small tables, and what reads and writes beside it."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmark.operators import agent, layout, providers, scip
from quillmark.sources import scip as scip_files
from quillmark.store import Denied, Store, document_metadata, uploaded
from quillmark.streaming import framing, limiters

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    make = spark.createDataFrame
    return Store({
        "users": make([("u1", "w1", "d1", "a@x", "active"), ("u2", "w9", None, "b@x", "active"), ("u3", None, None, "c@x", "active")], "user_id string, default_workspace_id string, department_id string, normalized_email string, status string"),
        "workspaces": make([("w1", "One", "personal", "one", "u1", "active"), ("w2", "Two", "team", "two", "u2", "active"), ("w9", "Gone", "team", "gone", "u1", "closed")], "workspace_id string, workspace_name string, workspace_type string, normalized_name string, owner_user_id string, status string"),
        "memberships": make([("w1", "u1", "owner", "active", DAY), ("w1", "u2", "editor", "active", DAY), ("w2", "u2", "owner", "active", DAY + dt.timedelta(1)), ("w9", "u2", "viewer", "active", DAY)], "workspace_id string, user_id string, role string, status string, joined_at timestamp"),
        "invitations": make([("i1", "w1", "c@x", "viewer", "t1", DAY + dt.timedelta(9), None, None, None)], "invitation_id string, workspace_id string, normalized_email string, role string, token_hash string, expires_at timestamp, accepted_at timestamp, revoked_at timestamp, accepted_by_user_id string"),
        "documents": make([(1, "w1", "rag", "workspace", None, None, "u1", "b", 1, "active", None), (2, "w1", "rag", "personal", "u2", None, "u2", "a", 2, "active", None), (3, "w1", "wiki", "department", None, "d1", "u1", "c", 3, "active", None), (4, "w2", "rag", "workspace", None, None, "u2", "d", 4, "active", None)], "document_id long, workspace_id string, source_type string, scope_type string, owner_user_id string, owner_department_id string, created_by_user_id string, title string, imported_at long, status string, invalid_reason string"),
        "chunks": make([(1, "child"), (1, "child"), (1, "parent"), (2, "child")], "document_id long, chunk_level string"),
        "revisions": make([(1, 1), (1, 2), (2, 1)], "document_id long, revision_no long"),
        "projects": make([("p1", "shop", "w1", "workspace", "u1", "active", "c1", "k1"), ("p2", "till", "w1", "private", "u1", "active", "c1", "k2"), ("p3", "own", "w1", "private", "u2", "active", "c2", None)], "project_id string, project_name string, workspace_id string, access_scope string, owner_user_id string, status string, current_commit string, repository_key string"),
        "grants": make([("p2", "u2", "read", "disabled"), ("p2", "u3", "write", "active")], "project_id string, user_id string, permission string, status string"),
        "files": make([(10, "p1", "c1", "a.py", "parsed", "9f"), (11, "p1", "c0", "old.py", "parsed", "x"), (12, "p3", "c2", "b.yaml", "partial", "y")], "file_id long, project_id string, commit_hash string, path string, parser_status string, content_hash string"),
        "symbols": make([(100, "p1", "c1", 10, "run", "run", "function", 1, 3), (101, "p1", "c1", 10, "Box", "Box", "class", 5, 9), (102, "p3", "c2", 12, "x", "x", "function", 1, 1)], "symbol_id long, project_id string, commit_hash string, file_id long, name string, qualified_name string, symbol_kind string, start_line int, end_line int"),
        "relations": make([(1, 100, 101, "calls", "Box", 0.8, "p1", "c1"), (2, 100, None, "imports", "os", 0.9, "p1", "c1")], "relation_id long, source_symbol_id long, target_symbol_id long, relation_type string, target_ref string, confidence double, project_id string, commit_hash string"),
        "facts": make([(1, "p1", "c1", "http_api", "run", "GET /", "a.py", 2, 100), (2, "p1", "c1", "component", "gRPC", "rpc", "a.py", 1, None)], "fact_id long, project_id string, commit_hash string, fact_type string, name string, value string, source_path string, source_line int, source_symbol_id long"),
        "links": make([(1, 2, "uses", "p1", "c1")], "source_fact_id long, target_fact_id long, relation_type string, project_id string, commit_hash string"),
        "config": make([("p1", "c1", "a/compose.yml", 3, "compose_image", "services.web.image", "web:1", "docker_compose"), ("p1", "c1", "b.yaml", 1, "config_key", "port", "80", "yaml")], "project_id string, commit_hash string, path string, line int, fact_type string, key_path string, value string, config_format string"),
    })


def ids(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_scopes_follow_memberships(store):
    one, two = store.scope("u1"), store.scope("u2")
    assert (one.workspace_id, one.role, one.project_ids) == ("w1", "owner", ("p1", "p2")) and (two.workspace_id, two.role, two.project_ids) == ("w1", "editor", ("p1", "p3"))  # the default is closed
    assert store.scope("u2", "w2").role == "owner" and ids(store.my_workspaces("u2"), "workspace_id") == ["w1", "w2"]
    with pytest.raises(Denied):
        store.scope("u3")
    with pytest.raises(Denied):
        store.scope("u1", "w2")
    assert ids(store.members(one), "user_id") == ["u1", "u2"]


def test_members_change_and_defaults_are_repaired(store):
    owner, editor = store.scope("u1"), store.scope("u2")
    roles = lambda s: {(r["workspace_id"], r["user_id"]): (r["role"], r["status"]) for r in s["memberships"].collect()}
    assert roles(store.change_member(owner, "u2", "set_role", "admin"))["w1", "u2"] == ("admin", "active")
    assert roles(store.change_member(editor, "u1", "remove"))["w1", "u1"] == ("owner", "active")
    after = store.change_member(editor, "u2", "leave")
    assert roles(after)["w1", "u2"] == ("editor", "disabled") and after["users"].filter("user_id = 'u2'").first()["default_workspace_id"] == "w2"
    given = store.transfer_ownership(owner, "u2")
    moved, held = roles(given), {r["workspace_id"]: r["owner_user_id"] for r in given["workspaces"].collect()}
    assert moved["w1", "u1"][0] == "admin" and moved["w1", "u2"][0] == "owner" and held == {"w1": "u2", "w2": "u2", "w9": "u1"}
    named = store.but(workspaces=store["workspaces"].withColumn("normalized_name", F.lit("same")))
    assert roles(named.transfer_ownership(owner, "u2"))["w1", "u2"][0] == "editor"
    assert store.switch_default("u2", "w2")["users"].filter("user_id = 'u2'").first()["default_workspace_id"] == "w2"
    assert store.switch_default("u2", "w9")["users"].filter("user_id = 'u2'").first()["default_workspace_id"] == "w9"  # not valid: as it was
    with pytest.raises(Denied):
        store.transfer_ownership(editor, "u1")


def test_scopes_are_asked_again(store):
    editor = store.scope("u2")
    assert store.still(editor, ("p1",)) == editor
    closed = store.but(projects=store["projects"].withColumn("access_scope", F.lit("private")))
    with pytest.raises(Denied):
        closed.still(editor, ("p1",))
    with pytest.raises(Denied):
        store.change_member(editor, "u2", "leave").still(editor)


def test_invitations_and_handover(store, spark):
    now = F.lit(DAY + dt.timedelta(1))
    tokens = spark.createDataFrame([("t1", "u3", "c@x")], "token_hash string, user_id string, normalized_email string")
    after = store.accept_invitation(tokens, now)
    assert {r["user_id"]: r["default_workspace_id"] for r in after["users"].collect()} == {"u1": "w1", "u2": "w9", "u3": "w1"}
    assert after.scope("u3").workspace_id == "w1" and after["invitations"].first()["accepted_by_user_id"] == "u3"
    assert store.accept_invitation(tokens.withColumn("normalized_email", F.lit("z@x")), now)["memberships"].count() == 4
    assert store.revoke_invitation(store.scope("u1"), "i1", now)["invitations"].first()["revoked_at"] is not None
    passed = store.hand_over(spark.createDataFrame([("u1", "u2")], "source_id string, target_id string"))
    rows = {(r["workspace_id"], r["user_id"]): (r["role"], r["status"]) for r in passed["memberships"].collect()}
    assert rows["w1", "u2"] == ("owner", "active") and rows["w1", "u1"][1] == "disabled" and rows["w2", "u2"] == ("owner", "active")
    assert {r["workspace_id"]: (r["owner_user_id"], r["workspace_type"]) for r in passed["workspaces"].collect()}["w1"] == ("u2", "team")
    assert set(ids(passed["projects"], "owner_user_id")) == {"u2"} and passed["users"].filter("user_id = 'u1'").first()["status"] == "disabled"
    made = store.create_workspace(spark.createDataFrame([("n1", "Fresh", "fresh", "u1", DAY), ("n2", "x", "x", "u1", DAY), ("n3", "One", "one", "u1", DAY)], "workspace_id string, workspace_name string, normalized_name string, owner_user_id string, joined_at timestamp"))
    assert made["workspaces"].count() == 4 and made.scope("u1", "n1").role == "owner"


def test_documents_under_a_scope(store):
    owner, editor = store.scope("u1"), store.scope("u2")
    assert [(r["document_id"], r["chunk_count"]) for r in store.knowledge(owner).collect()] == [(3, 0), (1, 2)]
    assert ids(store.knowledge(editor, source_type="rag"), "document_id") == [2, 1] and ids(store.knowledge(editor, scope_type="personal"), "document_id") == [2]
    assert ids(store.revisions(editor, 1), "nth") == [1, 2] and store.revisions(owner, 2).count() == 0
    status = lambda s: {r["document_id"]: r["status"] for r in s["documents"].collect()}
    assert status(store.invalidate(editor, 1, "old"))[1] == "active" and status(store.invalidate(editor, 2, "old"))[2] == "invalid" and status(store.invalidate(owner, 4, "old"))[4] == "active"
    assert status(store.invalidate(owner, 1, "old").restore(owner, 1))[1] == "active"
    after = store.delete(owner, 1)
    assert sorted(ids(after["documents"], "document_id")) == [2, 3, 4] and after["chunks"].count() == 1 and after["revisions"].count() == 1


def test_code_under_a_scope(store, spark):
    owner, editor = store.scope("u1"), store.scope("u2")
    assert ids(store.projects(editor), "project_id") == ["p3", "p1"] and ids(store.projects(owner), "project_id") == ["p1", "p2"]
    counts = store.overview(owner, "p1").first()
    assert (counts["file_count"], counts["symbol_count"], counts["relation_count"], counts["fact_count"], counts["link_count"]) == (1, 2, 2, 2, 1)
    assert store.overview(owner, "p3").count() == 0
    assert [(r["path"], r["symbol_count"], r["relation_count"]) for r in store.files(owner, "p1").collect()] == [("a.py", 2, 2)]
    page, about = store.inventory(owner, "p1", commit="c0")
    assert ids(page, "path") == ["old.py"] and about.first()["has_more"] is False and about.first()["parsed"] == 1
    facts, links = store.architecture(owner, "p1")
    assert ids(facts, "fact_id") == [2, 1] and links.first()["source_name"] == "run" and links.first()["target_name"] == "gRPC"
    page, n = store.config(owner, "p1", query="compose")
    assert ids(page, "path") == ["a/compose.yml"] and n.first()["count"] == 1 and store.config(owner, "p1", kinds=["config_key"], prefix="b")[1].first()["count"] == 1
    assert ids(store.symbols(owner, "p1", "BOX"), "symbol_id") == [101] and store.symbols(owner, "p1", commit="c0").count() == 0
    detail = store.symbol(owner, 100)
    assert [(r["target_ref"], r["target_name"]) for r in detail["relations"].collect()] == [("Box", "Box"), ("os", None)] and ids(store.symbol(owner, 101)["incoming"], "source_name") == ["run"]
    assert store.symbol(owner, 102)["symbol"].count() == 0
    found, nodes = store.call_chain(owner, "p1", 100)
    assert {r["symbol_id"] for r in found.nodes.collect()} == {100, 101} and nodes.filter("symbol_id = 100").first()["facts"][0]["fact_id"] == 1
    texts = spark.createDataFrame([("a.py", "one\ntwo\n")], "path string, content string")
    with pytest.raises(Exception, match="content has changed"):
        store.source(owner, "p1", "a.py", texts).collect()
    with pytest.raises(Denied):
        store.source(owner, "p1", "old.py", texts)
    after = store.delete_projects(editor, ["p1", "p3"])
    assert set(ids(after["projects"], "project_id")) == {"p1", "p2"} and after["symbols"].count() == 2


def test_operation(store, spark, tmp_path):
    assert store.ready({"users": {"user_id": "string"}}).count() == 0 and store.ready({"users": {"x": "int"}, "y": {}}).count() == 2
    assert store.audited(str(tmp_path / "audit"), "login", "denied", "u1") and spark.read.parquet(str(tmp_path / "audit")).first()["outcome"] == "denied"

    def broken(df, to):
        raise OSError("full")

    assert not store.audited(str(tmp_path / "audit"), "login", "denied", write=broken)
    store.write(str(tmp_path / "v2"), ["users"])
    assert Store.at(spark, str(tmp_path / "v2"), ["users"])["users"].count() == 3
    files = spark.createDataFrame([("shop/a.py", bytearray(b"x")), ("shop/../b", bytearray(b"y")), ("alone", bytearray(b"z")), ("shop/big", bytearray(b"1234567"))], "path string, content binary")
    good, bad = uploaded(files, 10, 100, 5)
    assert [(r["folder"], r["path"]) for r in good.collect()] == [("shop", "a.py")] and {r["path"]: r["reason"] for r in bad.collect()} == {"shop/../b": "path", "alone": "path", "shop/big": "file_size"}
    meta = document_metadata(files, store.scope("u1"), "rag", "personal", "Ann").filter("title = 'a.py'").first()
    assert (meta["owner_user_id"], meta["workspace_name"], meta["owner_department_id"], meta["project_name"]) == ("u1", None, None, None) and meta["content_hash"] == __import__("hashlib").sha256(b"x").hexdigest()


def encoded(*parts: tuple[int, object]) -> bytes:
    """A message by the wire format."""
    out = b""

    def number(n: int) -> bytes:
        raw = b""
        while True:
            raw += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return raw

    for field, value in parts:
        if isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            raw = value.encode() if isinstance(value, str) else bytes(value)
            out += number(field << 3 | 2) + number(len(raw)) + raw
    return out


def test_binary_index_is_read_and_merged(spark):
    info = lambda name, kind, *more: encoded((1, name), (5, kind), *more)
    occurrence = lambda name, roles, *where: encoded((1, bytes(where)), (2, name), (3, roles))
    document = encoded((1, "src/a.go"), (2, occurrence("pkg/Run().", 1, 1, 0, 3)), (2, occurrence("pkg/Base#", 1, 7, 0, 4)), (2, occurrence("pkg/Base#", 0, 2, 0, 4)), (2, occurrence("pkg/Fresh#", 1, 30, 0, 200, 1)), (3, info("pkg/Run().", 17, (4, encoded((1, "pkg/Base#"), (3, 1), (4, 1))), (4, encoded((1, "ext/X#"), (2, 1))))), (3, info("pkg/Base#", 7)), (3, info("pkg/Fresh#", 7, (6, "Fresh"), (3, "doc"), (7, encoded((5, "type Fresh struct"))))))
    raw = encoded((1, encoded((3, "root"))), (2, document), (3, info("ext/X#", 0)))
    rows = scip_files.index(spark.createDataFrame([("mod", bytearray(raw)), ("", None)], "prefix string, content binary"))
    occurrences = rows.filter("record = 'occurrence'").select("path", "symbol", "roles", "range", "enclosing")
    assert occurrences.count() == 4 and occurrences.first()["path"] == "mod/src/a.go" and occurrences.first()["range"] == [1, 0, 3]
    symbols = spark.createDataFrame([(1, "mod/src/a.go", "file", "file", 1, 40), (2, "mod/src/a.go", "Run", "function", 2, 5), (3, "mod/src/a.go", "Base", "type", 8, 9)], "symbol_id long, path string, name string, kind string, start_line int, end_line int")
    infos = rows.filter("record = 'symbol'").select("symbol", scip_files.kind_name(F.col("kind")).alias("kind_name"), "display_name", "signature", "documentation")
    assert {(r["symbol"], r["kind_name"]) for r in infos.collect()} == {("pkg/Run().", "function"), ("pkg/Fresh#", "class"), ("pkg/Base#", "class"), ("ext/X#", "symbol")}
    related = scip.related(rows.filter("record = 'relation'").select("symbol", "target", "relations"), infos, occurrences, symbols)
    assert {(r["source_id"], r["relation_type"], r["target_id"], r["target_ref"]) for r in related.collect()} == {(2, "implements", 3, "pkg/Base#"), (2, "type_definition", 3, "pkg/Base#"), (2, "related_reference", None, "ext/X#")}
    fresh = scip.enriched(infos, occurrences, symbols).collect()
    assert [(r["name"], r["qualified_name"], r["kind"], r["signature"], r["docstring"], r["start_line"], r["end_line"]) for r in fresh] == [("Fresh", "Fresh@31", "class", "type Fresh struct", "doc", 1, 1)]
    name = lambda s, d: spark.range(1).select(scip.display_name(F.lit(s), F.lit(d)).alias("n")).first()["n"]
    assert (name("local 3", ""), name("a b `p`/Box#get().", ""), name("x", "Shown")) == ("3", "get", "Shown")


def test_tables_of_pages(spark):
    cells = [(1, r, c, t) for r, row in enumerate([["Name", "", "Size"], [None, " ", ""], ["a\nb", "x", "1"], ["c", "y", "2", ]]) for c, t in enumerate(row)] + [(2, 0, 0, "alone")]
    df = spark.createDataFrame(cells, "table_id int, row int, col int, text string")
    head = "表格列：Name；列2；Size"
    assert [r["content"] for r in layout.table_chunks(df, 1000).collect()] == [head + "\n表格行：Name：a b；列2：x；Size：1\n表格行：Name：c；列2：y；Size：2"]
    assert [r["content"] for r in layout.table_chunks(df, 30).orderBy("chunk_index").collect()] == [head + "\n表格行：Name：a b；列2：x；Size：1", head + "\n表格行：Name：c；列2：y；Size：2"]


def test_pages_without_lines_are_kept(spark):
    rows = spark.createDataFrame([(1, 1, 600.0, 800.0, 780.0, 790.0, 300.0, 310.0, "1"), (1, 2, 600.0, 800.0, 400.0, 410.0, 50.0, 90.0, "body")], "doc_id int, page int, width double, height double, top double, bottom double, x0 double, x1 double, text string")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id int, page int")
    assert {(r["page"], r["text"]) for r in layout.page_text(rows, pages).collect()} == {(1, ""), (2, "body"), (3, "")}


def test_frames_cut_anywhere(spark):
    body = "event: step\ndata: {\"a\": 1}\n\ndata: plain\n\nevent: done\ndata: {}\n\nevent: open"
    for size in (1, 3, 7, 1000):
        chunks = [(1, i, body[a : a + size]) for i, a in enumerate(range(0, len(body), size))]
        got = framing.frames(spark.createDataFrame(chunks, "stream_id int, seq int, body string")).orderBy("nth").collect()
        assert [(r["event"], r["data"]) for r in got] == [("step", '{"a": 1}'), ("message", "plain"), ("done", "{}")]
        ends = [body.index("\n\n", at) + 1 for at in (0, 30, 45)]
        assert [r["seq"] for r in got] == [e // size for e in ends]


def test_providers_answer_from_a_script(spark):
    ask = providers.scripted([("^plan", '{"tool_calls": [{"id": "c1", "name": "search", "arguments": "{}"}]}'), ("^grade", '{"sufficient": true, "missing": ["x"]}')], "plain words")
    rows = spark.createDataFrame([(1, "plan"), (2, "grade"), (3, "other"), (4, None)], "id int, task string").withColumn("answer", providers.completed(F.col("task"), ask))
    got = {r["id"]: r for r in rows.select("id", "answer", providers.tool_calls(F.col("answer")).alias("calls"), providers.graded(F.col("answer")).alias("grade")).collect()}
    assert got[1]["calls"][0]["name"] == "search" and got[2]["grade"]["sufficient"] and got[3]["calls"] == [] and not got[3]["grade"]["sufficient"] and got[4]["answer"] is None
    pieces = providers.streamed(rows, "id", "answer", 4).filter("id = 3").orderBy("seq").collect()
    assert "".join(r["delta"] for r in pieces) == "plain words" and len(pieces) == 3
    prompt = spark.range(1).select(providers.asked_for("grade", question=F.lit("q")).alias("p")).first()["p"]
    assert prompt == 'grade\n{"question":"q"}'


def test_payloads_at_any_depth(spark):
    payload = {"result": {"items": [{"citation": "[C2]", "x": [{"my_Citation": "see [C1] [C2]"}]}, {"citation": "none"}], "total": 3}}
    rows = agent.payloads_by_citation(spark.createDataFrame([(1, 1, json.dumps(payload)), (1, 2, "not json"), (2, 1, None)], "answer_id long, seq long, payload string")).collect()
    assert [(r["citation"], json.loads(r["content"]).get("citation")) for r in rows] == [("C2", "[C2]"), ("C1", None), ("C2", None)]


def test_sessions_are_touched(spark):
    at = dt.datetime(2024, 1, 1, 12)
    hour = dt.timedelta(hours=1)
    rows = [(1, None, at + hour, at + hour, at - hour, 1, 1), (2, at, at + hour, at + hour, at, 1, 1), (3, None, at + hour, at + hour, at, 1, 2), (4, None, at, at + hour, at, 1, 1), (5, None, at + hour, at, at, 1, 1), (6, None, at + hour, at + hour, at - dt.timedelta(minutes=4), 1, 1)]
    df = spark.createDataFrame(rows, "id int, revoked_at timestamp, expires_at timestamp, idle_expires_at timestamp, last_seen_at timestamp, auth_version int, user_version int")
    got = {r["id"]: r for r in limiters.checked_sessions(df, F.lit(at), 720).collect()}
    assert {i: r["refused"] for i, r in got.items()} == {1: None, 2: "revoked", 3: "changed", 4: "expired", 5: "idle", 6: None}
    assert got[1]["touch"] and got[1]["idle_expires_at"] == at + hour and not got[6]["touch"]


def test_sliding_log_in_a_stream(spark, tmp_path):
    rows = [(i, "k", DAY + dt.timedelta(minutes=i), i == 5) for i in range(12)]
    table = spark.createDataFrame(rows, "event_id long, k string, ts timestamp, ok boolean")
    table.write.parquet(str(tmp_path / "in"))
    want = {r["event_id"]: r["admitted"] for r in limiters.sliding_log_table(table, "k", "ts", "event_id", 3, 240.0, "ok").collect()}
    assert want[0] and not want[3] and want[5] and want[6]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = limiters.sliding_log_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "k", "ts", 3, 240.0, "ok")
    run = stream.writeStream.format("memory").queryName("sliding").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["event_id"]: r["admitted"] for r in spark.table("sliding").collect()} == want


def test_tools_stay_in_their_project_and_version(store, spark):
    from quillmark import tools

    texts = spark.createDataFrame([("a.py", "one\ntwo\n")], "path string, content string")
    pinned = store.but(files=store["files"].withColumn("content_hash", F.sha2(F.lit("one\ntwo\n"), 256)))
    at = tools.Pinned(pinned, store.scope("u1"), "p1", "c1", texts)
    assert ids(tools.call(at, "list_project_files", {})["items"], "path") == ["a.py"]
    assert ids(tools.call(at, "search_symbols", {"query": " run "})["items"], "symbol_id") == [100]
    got = tools.call(at, "get_symbol", {"symbol_id": 100})
    assert got["symbol"].first()["path"] == "a.py" and got["outgoing"].count() == 2 and got["incoming"].count() == 0
    assert [r["text"] for r in tools.call(at, "read_source", {"path": "a.py", "start_line": 2, "end_line": 2})["lines"].collect()] == ["two"]
    assert {r["symbol_id"] for r in tools.call(at, "trace_call_path", {"symbol_id": 100, "max_depth": 9})["nodes"].collect()} == {100, 101}
    assert ids(tools.call(at, "find_architecture", {"query": "GRPC"})["facts"], "fact_id") == [2]
    assert tools.call(at, "find_config_facts", {"query": "80"})["count"].first()["count"] == 1
    assert tools.call(at, "finish_investigation", {"reason": "done", "evidence_sufficient": True})["finished"].first()["reason"] == "done"
    for name, arguments in (("drop", {}), ("search_symbols", {}), ("get_symbol", {"symbol_id": 102}), ("list_project_files", {"x": 1}), ("list_project_files", {"limit": "9"})):
        with pytest.raises(tools.Refused):
            tools.call(at, name, arguments)
    with pytest.raises(tools.Refused):
        tools.call(tools.Pinned(store, store.scope("u1"), "p1", " "), "list_project_files", {})


def test_references_of_an_index(spark):
    """Recursion stays, two unknown symbols of one short name are two relations, other kinds are no targets, definitions
    reach as far as their enclosing range."""
    symbols = spark.createDataFrame([(1, "a", "file", "file", 1, 90, None, None), (2, "a", "run", "function", 3, 9, None, "own")], "symbol_id long, path string, name string, kind string, start_line int, end_line int, signature string, docstring string")
    rows = [("a", "p/run().", 1, [2, 4, 7], [2, 0, 8, 1]), ("a", "p/run().", 0, [5, 0, 3], None), ("a", "x/print().", 0, [5, 0, 3], None), ("a", "y/print().", 0, [5, 4, 9], None), ("a", "y/print().", 8, [5, 12, 17], None), ("a", "p/Box#", 1, [19, 0, 3], [19, 0, 29, 1]), ("a", "p/Box#n.", 1, [21, 0, 3], None), ("a", "p/Box#n.", 0, [24, 0, 3], None), ("a", "p/Box#", 2, [80, 0, 3], None)]
    occurrences = spark.createDataFrame(rows, "path string, symbol string, roles int, range array<int>, enclosing array<int>")
    infos = spark.createDataFrame([("p/run().", "function", "run", "def run()", "doc"), ("p/Box#", "class", "Box", None, None), ("p/Box#n.", "variable", "n", None, None)], "symbol string, kind_name string, display_name string, signature string, documentation string")
    box = scip.enriched(infos, occurrences, symbols).collect()
    assert [(r["name"], r["start_line"], r["end_line"]) for r in box] == [("Box", 20, 30)]
    found = {(r["source_id"], r["relation_type"], r["target_id"], r["target_ref"], r["line"]) for r in scip.references(infos, occurrences, symbols).collect()}
    assert found == {(2, "references", 2, "p/run().", 6), (2, "references", None, "x/print().", 6), (2, "references", None, "y/print().", 6), (box[0]["symbol_id"], "references", None, "p/Box#n.", 25), (1, "imports", box[0]["symbol_id"], "p/Box#", 81)}
    assert {(r["symbol_id"], r["signature"], r["docstring"]) for r in scip.completed(infos, occurrences, symbols).collect()} == {(1, None, None), (2, "def run()", "own")}


def test_evidence_survives_its_reranker(spark, store):
    from quillmark import api

    texts = [(k, "rag", f"{word} are kept in the cellar. " * 12) for k, word in enumerate(("lamps", "ropes", "maps"))]
    docs = spark.createDataFrame([(k, "w1", kind, text, "workspace", None, None, "active") for k, kind, text in texts], "document_id long, workspace_id string, source_type string, text string, scope_type string, owner_user_id string, owner_department_id string, status string")
    own = store.but(documents=docs, chunks=api.chunked(docs).cache())
    scope = own.scope("u1")
    good = own.evidence(scope, "where are the ropes", top=2).orderBy("rank").collect()
    assert good[0]["document_id"] == 1 and {r["warning"] for r in good} == {None} and good[0]["context_level"] == "parent"
    down = own.evidence(scope, "where are the ropes", top=2, rerank=F.raise_error(F.lit("down")).cast("double")).orderBy("rank").collect()
    assert 1 <= len(down) <= 2 and {r["warning"] for r in down} == {"reranker_fallback"}
    bare = own.evidence(scope, "where are the ropes", top=2, budget=0).collect()
    assert bare and {r["context_level"] for r in bare} == {"child"}
