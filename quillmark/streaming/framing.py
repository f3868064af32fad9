"""Event frames and streamed tool calls out of pieces that were cut anywhere: the same parser for tables and for streams.

Only what no blank line has closed yet is kept of a stream, and pieces that came before their turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAMES = "stream_id string, nth long, event string, data string, seq long"
CALLS = "stream_id string, call_index long, id string, name string, arguments string"


def parsed(block: str) -> tuple[str, str]:
    """A block's event (`message` if none is named) and data, each of the last line that has it."""
    event, data = "message", ""
    for line in block.splitlines():
        if line.startswith("event:"):
            event = line[6:].strip() or "message"
        elif line.startswith("data:"):
            data = line[5:].strip()
    return event, data


def fed(tail: str, piece: str) -> tuple[list[tuple[str, str]], str]:
    """The frames that end in the piece, and the new tail. Blocks of blanks are no frames."""
    *blocks, tail = (tail + piece).split("\n\n")
    return [parsed(b) for b in blocks if b.strip()], tail


def frames(pieces: DataFrame) -> DataFrame:
    """pieces (stream_id, seq, body): stream_id, nth (from 0), event, data, and seq, the piece that ended the frame. Arrow
    batches of pieces in order; a stream is held as far as its last frame is open. Null bodies are empty."""

    def run(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tail, nth = None, "", 0
        for rows in pdf:
            out = []
            for stream, seq, body in rows.itertuples(index=False):
                if stream != at:
                    at, tail, nth = stream, "", 0
                found, tail = fed(tail, body)
                out += [(stream, nth + k, *f, seq) for k, f in enumerate(found)]
                nth += len(found)
            yield pd.DataFrame(out, columns=["stream_id", "nth", "event", "data", "seq"])

    own = _pieces(pieces).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return own.mapInPandas(run, FRAMES)


def _pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("body", F.lit("")).alias("body"))


class Frames(StatefulProcessor):
    """Keyed by stream: the open tail, the number of the next frame and of the next piece, and pieces that came early. A
    piece that was taken before is ignored. Pieces are numbered from 0 without gaps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "tail string, nth long, seq long")
        self.early = handle.getMapState("early", "seq long", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        tail, nth, seq = self.open.get() if self.open.exists() else ("", 0, 0)
        out = []
        here = {r.seq: r.body for pdf in rows for r in pdf.itertuples(index=False) if r.seq >= seq}
        while True:
            if seq in here:
                body = here.pop(seq)
            elif self.early.exists() and self.early.containsKey((seq,)):
                body = self.early.getValue((seq,))[0]
                self.early.removeKey((seq,))
            else:
                break
            found, tail = fed(tail, body)
            out += [(key[0], nth + k, *f, seq) for k, f in enumerate(found)]
            nth, seq = nth + len(found), seq + 1
        for k, body in here.items():
            self.early.updateValue((k,), (body,))
        self.open.update((tail, nth, seq))
        yield pd.DataFrame(out, columns=["stream_id", "nth", "event", "data", "seq"])

    def close(self) -> None:
        pass


def frame_stream(pieces: DataFrame) -> DataFrame:
    """The frames of a stream of pieces, each in the micro-batch that closes it."""
    return _pieces(pieces).groupBy("stream_id").transformWithStateInPandas(Frames(), FRAMES, "Append", "None")


class Calls(StatefulProcessor):
    """Keyed by stream: the pieces of its open tool calls; a row with `done` closes and gives them all. Rows of a
    micro-batch are taken by seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "call_index long", "id string, name string, arguments string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for r in sorted((x for pdf in rows for x in pdf.itertuples(index=False)), key=lambda x: x.seq):
            if r.done:
                out += [(key[0], k[0], *v) for k, v in sorted(self.calls.iterator(), key=lambda x: x[0][0])] if self.calls.exists() else []
                self.calls.clear()
                continue
            at = (int(r.call_index),)
            had = tuple(self.calls.getValue(at)) if self.calls.exists() and self.calls.containsKey(at) else (None, None, "")
            self.calls.updateValue(at, merged(had, r.id, r.name, r.arguments))
        yield pd.DataFrame(out, columns=["stream_id", "call_index", "id", "name", "arguments"])

    def close(self) -> None:
        pass


def merged(had: tuple, id_: str | None, name: str | None, arguments: str | None) -> tuple:
    """A call with one more piece: the first id and name that come, the arguments one after another."""
    return had[0] if had[0] is not None else id_, had[1] if had[1] is not None else name, had[2] + (arguments or "")


def call_stream(deltas: DataFrame) -> DataFrame:
    """deltas (stream_id, seq, call_index, id, name, arguments, done): the merged calls, when their stream says done."""
    own = deltas.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("call_index").cast("long"), F.lit(-1)).alias("call_index"), "id", "name", "arguments", F.coalesce("done", F.lit(False)).alias("done"))
    return own.groupBy("stream_id").transformWithStateInPandas(Calls(), CALLS, "Append", "None")
