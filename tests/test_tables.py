"""Table functions in SQL, and code indexes as a data source."""

from __future__ import annotations

import os

import pytest

from quillmark.functions import tables
from quillmark.operators import chunking, facts, yamls
from quillmark.plans.chunks import MARKDOWN, SOURCES
from quillmark.sources import indexes, scip


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    indexes.register(spark)
    return spark.sql


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_table_functions_equal_the_frames(spark, sql, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for partition in ("", " PARTITION BY doc_id"):
        assert same(sql(f"SELECT * FROM split_windows(TABLE({{docs}}){partition}, text => 'text')", docs=docs), chunking.split_windows(docs))
        assert same(sql(f"SELECT * FROM split_parents(TABLE({{docs}}){partition}, text => 'text')", docs=docs), chunking.parent_child(docs).select("doc_id", "parent_index", "child_index", "chunk_level", "content", "char_count"))
    marks = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id int, text string")
    assert same(sql("SELECT * FROM split_markdown(TABLE({m}), text => 'text')", m=marks), chunking.exploded(marks, chunking.markdown, ["doc_id"], ["text"]))
    sources = spark.createDataFrame(SOURCES, "path string, content string")
    found = facts.extract(sources)
    assert same(sql("SELECT * FROM code_symbols(TABLE({s}), path => 'path', text => 'content')", s=sources), facts.symbols(found))
    assert same(sql("SELECT * FROM code_relations(TABLE({s}), path => 'path', text => 'content')", s=sources), facts.relations(found))
    files = spark.createDataFrame([("a.yaml", "a:\n  - b: 1\n"), ("bad.yaml", "a: [1\n")], "path string, content string")
    assert same(sql("SELECT * FROM yaml_nodes(TABLE({f}), text => 'content')", f=files), yamls.nodes(files))
    pieces = sql("SELECT path, ref FROM split_source(TABLE({s}), path => 'path', text => 'content')", s=sources)
    assert ("a/app.py", "function helper") in {tuple(r) for r in pieces.collect()}


def test_columns_go_along_and_mistakes_are_named(spark, sql):
    docs = spark.createDataFrame([(1, "a b", [1, None], {"k": 1}, "clash", None)], "id long, body string, list array<int>, map map<string,int>, content string, none double")
    row = sql("SELECT * FROM split_windows(TABLE({d}), text => 'body', size => 10, overlap => 0)", d=docs).first()
    assert row.asDict() == {"id": 1, "list": [1, None], "map": {"k": 1}, "none": None, "chunk_index": 0, "content": "a b", "char_count": 3}
    for call, said in (("text => 'gone'", "no such column"), ("text => 'id'", "not a string"), ("text => 'body', size => 0", "whole number"), ("text => 'body', sise => 3", "no argument is called sise")):
        with pytest.raises(Exception, match=said):
            sql(f"SELECT * FROM split_windows(TABLE({{d}}), {call})", d=docs).collect()


def records(n):
    for i in range(n):
        path = f"src/m{i:04}.go"
        yield "occurrence", path, f"pkg/F{i}().", 1, [i, 5, 300], [i, 0, i + 4, 1], None, None, None, None, None, None
        yield "occurrence", path, "pkg/Base#", 0, [i + 1, 2, 6], [], None, None, None, None, None, None
        yield "symbol", path, f"pkg/F{i}().", None, None, None, 17, f"F{i}", "func F()", "says", None, None
        yield "relation", path, f"pkg/F{i}().", None, None, None, None, None, None, None, "pkg/Base#", ["implements", "related_reference"]
    yield "symbol", None, "ext/X#", None, None, None, 7, None, None, None, None, None


@pytest.fixture(scope="module")
def written(spark, sql, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    rows = spark.createDataFrame(list(records(400)), scip.ROW)
    rows.repartition(1).sortWithinPartitions("path").write.format("code_index").mode("append").save(folder)
    return folder, rows


def test_index_is_read_as_it_was_written(spark, written):
    folder, rows = written
    assert [n for n in os.listdir(folder) if n.endswith(".scip")] == os.listdir(folder)
    for split in (1, 1000, 1 << 20):
        back = spark.read.format("code_index").option("split_bytes", split).load(folder)
        assert same(back, rows)
    assert spark.read.format("code_index").option("split_bytes", 1000).load(folder).rdd.getNumPartitions() > 10
    inside = scip.index(spark.createDataFrame([("", bytearray(open(f"{folder}/{os.listdir(folder)[0]}", "rb").read()))], "prefix string, content binary"))
    assert same(inside, rows)
    ranges = indexes.spans(spark.createDataFrame([("", folder)], "prefix string, path string"), 1000)
    assert ranges.count() > 10 and same(indexes.rows(ranges), rows)


def test_conditions_are_answered_in_the_reader(spark, written, monkeypatch):
    folder, rows = written
    load = lambda **options: spark.read.format("code_index").options(**options).load(folder)
    assert same(load(records="symbol"), rows.filter("record = 'symbol'"))
    assert same(load(records="relation,occurrence", only="src/m0003.go,src/none.go"), rows.filter("record IN ('relation', 'occurrence') AND path = 'src/m0003.go'"))
    assert same(load(starts="src/m00"), rows.filter("path LIKE 'src/m00%'"))
    whole = load()
    both = whole.filter("record = 'symbol'").alias("s").join(whole.filter("record = 'occurrence'").alias("o"), ["path", "symbol"])
    assert both.count() == 400
    with pytest.raises(Exception, match="not a kind of record"):
        load(records="symbols").collect()
    decoded = []
    real = scip.record_rows
    monkeypatch.setattr(scip, "record_rows", lambda *a: decoded.append(1) or real(*a))
    name = f"{folder}/{os.listdir(folder)[0]}"
    list(indexes.rows_of(name, "", 0, os.path.getsize(name), indexes.Wanted(paths=frozenset(["src/m0003.go"]))))
    assert len(decoded) == 1


def test_prefix_overwrite_and_damage(spark, sql, tmp_path):
    folder = str(tmp_path / "small")
    few = spark.createDataFrame(list(records(3)), scip.ROW).coalesce(1).sortWithinPartitions("path")
    few.write.format("code_index").mode("append").save(folder)
    few.filter("path = 'src/m0001.go'").coalesce(1).write.format("code_index").mode("overwrite").save(folder)
    moved = spark.read.format("code_index").option("prefix", "mod").load(f"file:{folder}")
    assert {r["path"] for r in moved.select("path").collect()} == {"mod/src/m0001.go"} and moved.filter("path = 'mod/src/m0001.go'").count() == 4
    (name,) = os.listdir(folder)
    with open(f"{folder}/{name}", "ab") as f:
        f.write(b"\x12\x7f")
    with pytest.raises(Exception, match="damaged index"):
        spark.read.format("code_index").load(folder).collect()
    with pytest.raises(Exception, match="gone"):
        spark.read.format("code_index").load(str(tmp_path / "gone")).collect()


def test_a_large_index_is_cut_without_being_held(tmp_path):
    path, one = str(tmp_path / "large.scip"), scip.encoded("a.go", [r for r in records(2000) if r[0] == "occurrence"])
    with open(path, "wb") as f:
        for _ in range(400):
            f.write(one)
    size = os.path.getsize(path)
    ranges = indexes.cut_points(path, size, 1 << 20)
    assert ranges[0][0] == 0 and ranges[-1][1] == size and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all((stop - start) % len(one) == 0 and stop - start < (1 << 20) + len(one) for start, stop in ranges)
    _, start, length = next(iter(indexes.Records(open(path, "rb"), *ranges[3])))
    assert start > ranges[3][0] and length < len(one)
