"""Stateful streams against their table forms, over several micro-batches, and what they keep in the end."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quillmark.operators import controller
from quillmark.streaming import framing, limiters

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Run a stream over tables that come one after another: its rows, and how many rows of state are left."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(make, *batches: dict):
        folders = {n: tmp_path / n for n in batches[0]}
        for k, batch in enumerate(batches):
            for name, df in batch.items():
                df.coalesce(1).write.mode("append").parquet(str(folders[name]))
            sources = {n: spark.readStream.schema(batches[0][n].schema).parquet(str(f)) for n, f in folders.items()}
            q = make(**sources).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
            left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
        return spark.read.parquet(str(tmp_path / "out")).collect(), left

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_limiter_state_goes_after_its_window(spark, streamed):
    r = random.Random(2)
    rows = [(i, f"k{r.randrange(5)}", DAY + dt.timedelta(minutes=3 * i + r.random())) for i in range(60)]
    schema = "event_id long, k string, ts timestamp"
    make = lambda own: spark.createDataFrame(own, schema)
    want = {x["event_id"]: x["attempts"] for x in limiters.fixed_window_table(make(rows), "k", "ts", "event_id", 2).collect()}
    far = DAY + dt.timedelta(days=2)
    got, left = streamed(lambda events: limiters.fixed_window_stream(events, "k", "ts", 2), {"events": make(rows[:25])}, {"events": make(rows[25:])}, {"events": make([(900, "z", far)])}, {"events": make([(901, "z", far + dt.timedelta(days=1))])}, {"events": make([(902, "z", far + dt.timedelta(days=1, minutes=1))])})
    assert {x["event_id"]: x["attempts"] for x in got if x["event_id"] < 900} == want
    assert left <= 1  # the last key's only


def test_sliding_log_state_goes_when_its_stamps_are_old(spark, streamed):
    rows = [(i, f"k{i % 3}", DAY + dt.timedelta(minutes=2 * i), i % 7 == 5) for i in range(40)]
    make = lambda own: spark.createDataFrame(own, "event_id long, k string, ts timestamp, ok boolean")
    want = {x["event_id"]: x["admitted"] for x in limiters.sliding_log_table(make(rows), "k", "ts", "event_id", 2, 900.0, "ok").collect()}
    late = lambda i, days: make([(i, "z", DAY + dt.timedelta(days=days), False)])
    got, left = streamed(lambda events: limiters.sliding_log_stream(events, "k", "ts", 2, 900.0, "ok"), {"events": make(rows[:17])}, {"events": make(rows[17:])}, {"events": late(900, 1)}, {"events": late(901, 2)}, {"events": late(902, 3)})
    assert {x["event_id"]: x["admitted"] for x in got if x["event_id"] < 900} == want
    assert left <= 1


def test_sessions_over_two_streams(spark, streamed):
    r = random.Random(9)
    rows = [(i, f"u{r.randrange(4)}", DAY + dt.timedelta(minutes=9 * i), r.choice(["login", "request", "request", "request", "revoke"])) for i in range(80)]
    make = lambda own: spark.createDataFrame(own, "event_id long, u string, ts timestamp, kind string")
    want = {x["event_id"]: (x["admitted"], x["touched"]) for x in limiters.session_requests(make(rows), "u", "ts", "event_id", "kind", 3600.0, 7200.0).collect()}
    assert {x[0] for x in want.values()} == {True, False}
    sides = lambda own: {"requests": make([x for x in own if x[3] != "revoke"]), "revocations": make([x for x in own if x[3] == "revoke"])}
    end = [(900 + k, "z", DAY + dt.timedelta(days=2 + k), kind) for k in range(3) for kind in ("request", "revoke")]
    got, left = streamed(lambda requests, revocations: limiters.session_stream(requests, revocations, "u", "ts", "kind", 3600.0, 7200.0), sides(rows[:40]), sides(rows[40:]), sides(end[:2]), sides(end[2:4]), sides(end[4:]))
    assert {x["event_id"]: (x["admitted"], x["touched"]) for x in got if x["event_id"] < 900} == want
    assert left == 0


BODY = "event: step\ndata: {\"a\": 1}\n\n: note\n\n\n\ndata: first\ndata: second\n\nevent:\ndata: x\n\nevent: done\r\ndata: é\n\nevent: open\ndata: never"


def test_frames_are_the_same_however_they_are_cut(spark, streamed):
    r, pieces, want = random.Random(5), [], []
    for stream in ("a", "b", "c"):
        cuts = sorted(r.sample(range(1, len(BODY)), r.choice([0, 5, 30])))
        pieces += [(stream, k, BODY[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(BODY)]))]
        want += [(stream, k, *f) for k, f in enumerate([("step", '{"a": 1}'), ("message", ""), ("message", "second"), ("message", "x"), ("done", "é")])]
    make = lambda own: spark.createDataFrame(own, "stream_id string, seq long, body string")
    table = framing.frames(make(pieces)).collect()
    assert sorted((x["stream_id"], x["nth"], x["event"], x["data"]) for x in table) == want
    r.shuffle(pieces)
    got, _ = streamed(lambda pieces: framing.frame_stream(pieces), *({"pieces": make(pieces[k::3])} for k in range(3)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, table))


def test_calls_close_with_their_stream(spark, streamed):
    rows = [("s", 0, 0, "i0", "find", '{"q": ', False), ("s", 1, 1, "i1", None, None, False), ("t", 0, 0, "j", "run", "{}", False), ("s", 2, 0, None, None, '"x"}', False), ("s", 3, 1, None, "read", "{}", False), ("s", 4, None, None, None, None, True), ("t", 1, 0, None, "no", "!", False)]
    schema = "stream_id string, seq long, call_index long, id string, name string, arguments string, done boolean"
    make = lambda own: spark.createDataFrame(own, schema)
    got, left = streamed(lambda deltas: framing.call_stream(deltas), {"deltas": make(rows[:3])}, {"deltas": make(rows[3:])})
    table = controller.merge_deltas(make(rows).filter("stream_id = 's' and not done")).select("stream_id", "call_index", "id", "name", "arguments").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, table)) == [("s", 0, "i0", "find", '{"q": "x"}'), ("s", 1, "i1", "read", "{}")]
    assert left == 1  # the stream that is not done
