"""Batches of documents against a catalogue, one row after another and all at once."""

from __future__ import annotations

import random

import pytest

from quillmark.operators import running, upserts

SCHEMA = "document_id long, source_type string, source_path string, content_hash string, workspace_id string, scope_type string, owner_user_id string, owner_department_id string, created_by_user_id string"


def one_by_one(existing: list[tuple], incoming: list[tuple]) -> dict:
    owned = lambda r: r[4:9]
    place = lambda r: (r[1], r[2], *owned(r)) if r[2] is not None else ("row", r[0])
    docs = {r[0]: [place(r), (r[3], *owned(r)), r[9]] for r in existing}
    rows, out = sorted(incoming), {}
    for i, r in enumerate(rows):
        p, content = place(r), (r[3], *owned(r))
        here = min((d for d, v in docs.items() if v[0] == p), default=None)
        if here is not None:
            changed = docs[here][1] != content
            docs[here][1:] = [content, docs[here][2] + changed]
            out[r[0]] = ("updated" if changed else "unchanged", here, docs[here][2])
            continue
        until = lambda d: min((x[0] for x in rows[i + 1 :] if place(x) == docs[d][0]), default=10**12)
        held = min(((-until(d), d) for d, v in docs.items() if v[1] == content), default=None)
        if held:
            out[r[0]] = ("reused", held[1], docs[held[1]][2])
        else:
            docs[r[0]] = [p, content, 1]
            out[r[0]] = ("created", r[0], 1)
    return out


def changes(spark, existing, incoming):
    found = upserts.classify(spark.createDataFrame(existing, SCHEMA + ", current_revision int"), spark.createDataFrame(incoming, SCHEMA))
    return {r["document_id"]: (r["change"], r["target_id"], r["revision"]) for r in found.collect()}


def row(i, path, content, kind="rag", creator="u"):
    return i, kind, path, content, "w", "workspace", None, None, creator


def test_rows_of_a_batch_see_each_other(spark):
    batch = [row(1, "/a", "h"), row(2, "/b", "h"), row(3, "/a", "h2"), row(4, "/b", "h"), row(5, "/c", "h2"), row(6, "/a", "h3", "wiki"), row(7, "/a", "h2", creator="v"), row(8, None, "h9"), row(9, None, "h9")]
    assert changes(spark, [], batch) == {
        1: ("created", 1, 1), 2: ("reused", 1, 1), 3: ("updated", 1, 2), 4: ("created", 4, 1), 5: ("reused", 1, 2), 6: ("created", 6, 1), 7: ("created", 7, 1), 8: ("created", 8, 1), 9: ("reused", 8, 1),
    }


@pytest.mark.parametrize("seed, bucket", [(1, 65_536), (2, 3)])
def test_batches_equal_rows_one_by_one(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(running, "BUCKET_ROWS", bucket)
    r, existing, seen = random.Random(seed), [], set()
    make = lambda i: (i, r.choice(["wiki", "rag"]), r.choice([None, "/p", "/q", "/r"]), f"h{r.randrange(4)}", "w", r.choice(["personal", "workspace"]), r.choice([None, "u1"]), None, "c")
    for i in range(12):
        x = make(1000 + i)
        if x[2] is None or (x[1:3], x[4:]) not in seen:
            seen.add((x[1:3], x[4:]))
            existing.append((*x, r.randint(1, 4)))
    incoming = [make(3 * i + r.randrange(3)) for i in range(90)]
    assert changes(spark, existing, incoming) == one_by_one(existing, incoming)


def test_revised_documents_are_active_again(spark):
    existing = spark.createDataFrame([(*row(1, "/a", "h"), 1, "invalid", "old"), (*row(2, "/b", "x"), 4, "invalid", "old")], SCHEMA + ", current_revision long, status string, invalid_reason string")
    batch = spark.createDataFrame([row(11, "/a", "h1"), row(12, "/a", "h2"), row(13, "/c", "n")], SCHEMA)
    after = upserts.upserted(existing, upserts.classify(existing, batch)).orderBy("document_id").collect()
    assert [(r["document_id"], r["content_hash"], r["current_revision"], r["status"], r["invalid_reason"]) for r in after] == [(1, "h2", 3, "active", None), (2, "x", 4, "invalid", "old"), (13, "n", 1, "active", None)]
    probe = {r["document_id"]: r["reusable_id"] for r in upserts.reusable(existing, spark.createDataFrame([row(21, "/b", "x"), row(22, "/n", "h"), row(23, "/a", "x2")], SCHEMA)).collect()}
    assert probe == {21: 2, 22: 1, 23: None}
