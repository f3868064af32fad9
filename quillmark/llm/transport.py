"""Media columns: MPEG transport streams in a binary column.

A payload is carried as private data: one program, one elementary stream, split into access units of UNIT bytes.
Each access unit is one elementary packet with a presentation time stamp; its first transport packet marks a
random-access point and carries the clock reference. The reader takes any stream of 188-byte packets: it finds the
program map through the association table, checks both tables' CRC, checks the continuity counters of the tables and of the
elementary stream, reassembles its packets and gives payload, time stamps and random-access points. A packet that is
repeated once with its counter counts once; a break that the discontinuity flag announces is none; packets marked as
damaged on the way are left out and reported. Tables may span packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import ready, tidy

# Fixed values of the format.
PACKET, SYNC, PRIVATE_DATA, PRIVATE_STREAM_1, CLOCK = 188, 0x47, 0x06, 0xBD, 90_000
#: Our own choices: where the map and the stream are, access unit bytes, ticks between units.
MAP_PID, STREAM_PID, PROGRAM, UNIT, TICKS = 0x1000, 0x0101, 1, 16_384, CLOCK // 25
BLOCK = 64


@lru_cache(maxsize=1)
def crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@lru_cache(maxsize=4096)
def crc(data: bytes) -> int:
    """CRC-32 of the format's sections (not reflected, start all ones)."""
    table, c = crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=64)
def table_packets(counter: int) -> bytes:
    """The association table and the program map, one packet each."""
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0")
    out = b""
    for pid, s in ((0, pat), (MAP_PID, pmt)):
        out += (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter]) + b"\0" + s).ljust(PACKET, b"\xff")
    return out


def stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def unit_packets(data: bytes, nth: int, counter: int) -> tuple[np.ndarray, int]:
    """The transport packets of one access unit and the next continuity counter."""
    pts = nth * TICKS & (1 << 33) - 1
    body = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + data
    first = min(len(body), PACKET - 4 - 8)
    middle, last = divmod(len(body) - first, PACKET - 4)
    n = 1 + middle + bool(last)
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) % 16
    raw = np.frombuffer(body, dtype=np.uint8)
    # first packet: adaptation field with random access and clock, stuffed if the unit ends here
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = PACKET - 5 - first, 0x50
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), dtype=np.uint8)
    out[0, PACKET - first :] = raw[:first]
    if middle:
        out[1 : 1 + middle, 4:] = raw[first : first + middle * (PACKET - 4)].reshape(middle, PACKET - 4)
    if last:
        room = PACKET - 4 - last  # of the adaptation field with its length byte
        out[-1, 3] |= 0x20
        out[-1, 4] = room - 1
        if room > 1:
            out[-1, 5] = 0
        out[-1, PACKET - last :] = raw[len(raw) - last :]
    return out, (counter + n) % 16


def write(payload: bytes) -> bytes:
    """A whole stream: the tables before the first unit and before every 64th after it."""
    out, counter = [], 0
    for nth, a in enumerate(range(0, max(1, len(payload)), UNIT)):
        if nth % 64 == 0:
            out.append(table_packets(nth // 64 % 16))
        packets, counter = unit_packets(payload[a : a + UNIT], nth, counter)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What the reader finds: payload, one entry for each elementary packet, and what was wrong."""

    payload: bytes = b""
    packets: int = 0
    program: int = -1
    stream_type: int = -1
    pts: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def continued(own: np.ndarray, what: str, errors: list[str]) -> np.ndarray:
    """The packets of one id without repeats and damaged ones; breaks of their continuity counters are reported."""
    damaged = own[:, 1] & 0x80 != 0
    if damaged.any():
        errors.append(f"{what}: {int(damaged.sum())} packets damaged on the way")
        own = own[~damaged]
    has_data = own[:, 3] & 0x10 != 0
    data = own[has_data]
    step = np.diff((data[:, 3] & 0x0F).astype(np.int16)) % 16
    again = np.append(False, (step == 0) & (data[1:, 4:] == data[:-1, 4:]).all(axis=1)) if len(data) > 1 else np.zeros(len(data), bool)
    again[1:] &= ~again[:-1]  # the format allows a packet twice, not three times
    announced = (data[:, 3] & 0x20 != 0) & (data[:, 4] > 0) & (data[:, 5] & 0x80 != 0)
    breaks = int(((step != 1) & ~again[1:] & ~announced[1:]).sum()) if len(data) > 1 else 0
    if breaks:
        errors.append(f"{what}: {breaks} breaks of continuity")
    keep = np.ones(len(own), bool)
    keep[np.flatnonzero(has_data)[again]] = False
    return own[keep]


def sections(packets: np.ndarray, table_id: int, errors: list[str]) -> Iterator[bytes]:
    """Whole different sections of a table from the packets of its id; a section may go on in the packets that follow."""
    seen, held = set(), b""

    def whole(raw: bytes) -> Iterator[bytes]:
        while len(raw) >= 3 and raw[0] != 0xFF:
            length = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
            s, raw = raw[:length], raw[length:]
            if s not in seen and s[0] == table_id:
                seen.add(s)
                if len(s) < 12 or len(s) < length or crc(s):
                    errors.append(f"table {table_id}: bad section")
                else:
                    yield s

    for p in packets:
        p = p.tobytes()
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if at >= PACKET or not p[3] & 0x10:
            continue
        if p[1] & 0x40:  # a section begins here, after what is left of the one before
            yield from whole(held + p[at + 1 : at + 1 + p[at]] if held else b"")
            held = p[at + 1 + p[at] :]
        elif held:
            held += p[at:]
    yield from whole(held)


def read(media: bytes) -> Stream:
    """Demultiplex the first elementary stream of the first program; problems are listed, not raised."""
    out = Stream()
    n = len(media) // PACKET
    if len(media) % PACKET:
        out.errors.append(f"{len(media) % PACKET} bytes after the last packet")
    all_ = np.frombuffer(media, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    good = all_[:, 0] == SYNC
    if not good.all():
        out.errors.append(f"{int((~good).sum())} packets without sync byte")
        all_ = all_[good]
    out.packets = len(all_)
    pid = (all_[:, 1].astype(np.int32) & 0x1F) << 8 | all_[:, 2]
    map_pid = stream_pid = -1
    for s in sections(continued(all_[pid == 0], "association table", out.errors), 0, out.errors):
        for i in range(8, len(s) - 4, 4):
            if (number := int.from_bytes(s[i : i + 2], "big")) and map_pid < 0:
                out.program, map_pid = number, int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for s in sections(continued(all_[pid == map_pid], "program map", out.errors), 2, out.errors):
        i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
        if stream_pid < 0 and i + 5 <= len(s) - 4:
            out.stream_type, stream_pid = s[i], int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF
    if stream_pid < 0:
        out.errors.append("no elementary stream")
        return out
    own = continued(all_[pid == stream_pid], "stream", out.errors)
    has_field, has_data = own[:, 3] & 0x20 != 0, own[:, 3] & 0x10 != 0
    skip = np.minimum(np.where(has_field, 5 + own[:, 4].astype(np.int32), 4), PACKET)
    skip[~has_data] = PACKET
    raw = own[np.arange(PACKET) >= skip[:, None]]
    begins = own[:, 1] & 0x40 != 0
    at = np.concatenate([[0], np.cumsum(PACKET - skip)])
    heads = at[:-1][begins].tolist()
    access = (has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0))[begins].tolist()
    data, parts, size = raw.tobytes(), [], 0
    for h, stop, ra in zip(heads, [*heads[1:], len(data)], access):
        if data[h : h + 3] != b"\0\0\1" or h + 9 > len(data):
            out.errors.append("bad start code")
            continue
        declared = int.from_bytes(data[h + 4 : h + 6], "big")
        body = data[h + 9 + data[h + 8] : min(stop, h + 6 + declared) if declared else stop]
        t = data[h + 9 : h + 14]
        out.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if data[h + 7] & 0x80 and len(t) == 5 else -1)
        out.starts.append(size)
        out.random_access.append(ra)
        if declared and stop < h + 6 + declared:
            out.errors.append("elementary packet cut short")
        parts.append(body)
        size += len(body)
    out.payload = b"".join(parts)
    return out


def seek(stream: Stream, pts: int) -> int:
    """Byte of the payload from which to read for time `pts`: the last random-access point not after it."""
    best = 0
    for at, t, ra in zip(stream.starts, stream.pts, stream.random_access):
        if ra and 0 <= t <= pts:
            best = at
    return best


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def feature(stream: Stream) -> str:
    """Of the payload: entropy of a byte, different bytes, zeros; of the stream: what the reader found."""
    t = [x for x in stream.pts if x >= 0]
    counts = np.bincount(np.frombuffer(stream.payload, dtype=np.uint8), minlength=256) if stream.payload else np.zeros(256)
    share = counts[counts > 0] / max(1, counts.sum())
    return f"bits={-(share * np.log2(share)).sum():.4f};different={len(share)};zeros={int(counts[0])};program={stream.program};type={stream.stream_type};packets={stream.packets};units={len(stream.pts)};random_access={sum(stream.random_access)};pts={min(t, default=-1)}..{max(t, default=-1)};errors={len(stream.errors)}"


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Store each text of docs (columns doc_id, text; others are ignored) as a transport stream and read it back.

    Returns doc_id, n_bytes, media (binary, if keep_media), payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pts (array), random_access (array of byte offsets), errors (array of strings). A null or
    empty text is one block of zeros. Equal texts give equal values. A stream that does not give back its payload
    raises. Repeated rows give repeated rows; an empty table gives none.
    """
    ready(docs.sparkSession)
    names = ["doc_id", "n_bytes", *(["media"] if keep_media else []), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "errors"]
    types = {"doc_id": (pa.int64(), "long"), "n_bytes": (pa.int64(), "long"), "media": (pa.binary(), "binary"), "payload_bytes": (pa.int64(), "long"), "payload_sha256": (pa.string(), "string"), "tail_crc32": (pa.int64(), "long"), "media_bytes": (pa.int64(), "long"), "media_sha256": (pa.string(), "string"), "feature": (pa.string(), "string"), "pts": (pa.list_(pa.int64()), "array<long>"), "random_access": (pa.list_(pa.int64()), "array<long>"), "errors": (pa.list_(pa.string()), "array<string>")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, payload = padded(text)
                media = write(payload)
                got = read(media)
                if got.payload != payload:
                    raise ValueError(f"document {doc_id}: the stream does not give back its payload: {got.errors}")
                row = {
                    "doc_id": doc_id, "n_bytes": n, "media": media, "payload_bytes": len(got.payload), "payload_sha256": hashlib.sha256(got.payload).hexdigest(),
                    "tail_crc32": zlib.crc32(got.payload[-BLOCK:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(got),
                    "pts": got.pts, "random_access": [a for a, ra in zip(got.starts, got.random_access) if ra], "errors": got.errors,
                }
                for k in names:
                    rows[k].append(row[k])
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], types[k][0]) for k in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), ", ".join(f"{n} {types[n][1]}" for n in names))
