"""Code indexes in their binary form: a source of rows for `operators.scip`, read by the wire format alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: field numbers of its messages, names of its symbol kinds from 1 on.
DOCUMENTS, EXTERNAL = 2, 3
DOC_PATH, DOC_OCCURRENCES, DOC_SYMBOLS = 1, 2, 3
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_ENCLOSING = 1, 2, 3, 7
SYM_NAME, SYM_DOCS, SYM_RELATIONS, SYM_KIND, SYM_DISPLAY, SYM_SIGNATURE = 1, 3, 4, 5, 6, 7
REL_SYMBOL, REL_REFERENCE, REL_IMPLEMENTATION, REL_TYPE, REL_DEFINITION, SIGNATURE_TEXT = 1, 2, 3, 4, 5, 5
KINDS = "array assertion associatedtype attribute axiom boolean class constant constructor datafamily enum enummember event fact field file function getter grammar instance interface key lang lemma macro method methodreceiver message module namespace null number object operator package packageobject parameter parameterlabel pattern predicate property protocol quasiquoter selfparameter setter signature subscript string struct".split()

ROW = "record string, path string, symbol string, roles int, range array<int>, enclosing array<int>, kind int, display_name string, signature string, documentation string, target string, relations array<string>"
TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers as they are, everything with a length as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("message cut short")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


def numbers(values: list[int | bytes]) -> list[int]:
    """A repeated number, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            at = 0
            while at < len(v):
                n, at = varint(v, at)
                out.append(n)
    return out


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def text(m: dict[int, list], number: int) -> str | None:
    return m[number][-1].decode(errors="replace") if number in m else None


def symbol_rows(path: str | None, data: bytes) -> Iterator[tuple]:
    m = message(data)
    docs = "\n\n".join(d.decode(errors="replace") for d in m.get(SYM_DOCS, [])) or None
    signature = text(message(m[SYM_SIGNATURE][-1]), SIGNATURE_TEXT) if SYM_SIGNATURE in m else None
    yield "symbol", path, text(m, SYM_NAME), None, None, None, m.get(SYM_KIND, [0])[-1], text(m, SYM_DISPLAY), signature, docs, None, None
    for r in map(message, m.get(SYM_RELATIONS, [])):
        said = [name for number, name in ((REL_IMPLEMENTATION, "implements"), (REL_TYPE, "type_definition"), (REL_REFERENCE, "related_reference"), (REL_DEFINITION, "related_definition")) if r.get(number, [0])[-1]]
        yield "relation", path, text(m, SYM_NAME), None, None, None, None, None, None, None, text(r, REL_SYMBOL), said


def record_rows(number: int, value: bytes, prefix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    """The rows of one record of an index; wanted names the kinds of rows to make (None: all)."""
    if wanted is None:
        wanted = frozenset(("occurrence", "symbol", "relation"))
    symbols = bool({"symbol", "relation"} & wanted)
    if number == EXTERNAL:
        yield from (r for r in (symbol_rows(None, value) if symbols else ()) if r[0] in wanted)
    elif number == DOCUMENTS:
        m = message(value)
        path = "/".join(p for p in (prefix, (text(m, DOC_PATH) or "").replace("\\", "/")) if p)
        for o in map(message, m.get(DOC_OCCURRENCES, []) if "occurrence" in wanted else []):
            yield "occurrence", path, text(o, OCC_SYMBOL), o.get(OCC_ROLES, [0])[-1], numbers(o.get(OCC_RANGE, [])), numbers(o.get(OCC_ENCLOSING, [])), None, None, None, None, None, None
        for s in m.get(DOC_SYMBOLS, []) if symbols else []:
            yield from (r for r in symbol_rows(path, s) if r[0] in wanted)


def index_rows(data: bytes, prefix: str) -> Iterator[tuple]:
    for number, value in fields(data):
        if number in (DOCUMENTS, EXTERNAL):
            yield from record_rows(number, value, prefix)


def number_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def field(number: int, value: int | str | bytes | None) -> bytes:
    """A field of a message; null, empty and zero values are left out."""
    if not value:
        return b""
    if isinstance(value, int):
        return number_bytes(number << 3) + number_bytes(value)
    data = value.encode() if isinstance(value, str) else value
    return number_bytes(number << 3 | 2) + number_bytes(len(data)) + data


def encoded(path: str | None, rows: list[tuple]) -> bytes:
    """The records of an index that give these ROW rows of a path; without path: a record for each external symbol."""
    relations: dict[str | None, list[bytes]] = {}
    for r in rows:
        if r[0] == "relation":
            said = set(r[11] or ())
            flags = b"".join(field(n, int(name in said)) for n, name in ((REL_REFERENCE, "related_reference"), (REL_IMPLEMENTATION, "implements"), (REL_TYPE, "type_definition"), (REL_DEFINITION, "related_definition")))
            relations.setdefault(r[2], []).append(field(SYM_RELATIONS, field(REL_SYMBOL, r[10]) + flags))
    symbols = [
        b"".join([field(SYM_NAME, r[2]), field(SYM_DOCS, r[9]), *relations.pop(r[2], []), field(SYM_KIND, r[6]), field(SYM_DISPLAY, r[7]), field(SYM_SIGNATURE, field(SIGNATURE_TEXT, r[8]))])
        for r in rows if r[0] == "symbol"
    ]
    if path is None:
        return b"".join(field(EXTERNAL, s) for s in symbols)
    packed = lambda values: b"".join(map(number_bytes, values or ()))
    found = [field(OCC_RANGE, packed(r[4])) + field(OCC_SYMBOL, r[2]) + field(OCC_ROLES, r[3]) + field(OCC_ENCLOSING, packed(r[5])) for r in rows if r[0] == "occurrence"]
    return field(DOCUMENTS, b"".join([field(DOC_PATH, path), *(field(DOC_OCCURRENCES, o) for o in found), *(field(DOC_SYMBOLS, s) for s in symbols)]))


def index(files: DataFrame) -> DataFrame:
    """files (prefix, content binary), one index each, prefix being its module's folder: ROW rows, record being
    occurrence, symbol or relation. A damaged index fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            for prefix, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(index_rows(content or b"", prefix or ""))
                cols = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names)

    return files.select(F.col("prefix").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ROW)


def kind_name(kind: Column) -> Column:
    """The name of a symbol's kind; indexers may leave it out: `symbol` then."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, KINDS)), F.when(kind > 0, kind)), F.lit("symbol"))
