"""Splitters: one document, many chunks. Arrow-batched; each text is read once, in time linear in its length."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD, CHILD_OVERLAP, PARENT = 700, 100, 2400
DEFAULT, DEFAULT_OVERLAP = 1400, 200

Piece = tuple[str, str]  # content, ref


def windows(text: str, size: int = DEFAULT, overlap: int = DEFAULT_OVERLAP) -> list[str]:
    """Windows of at most size characters. One that isn't the last ends at its last blank or line end, if that is
    beyond its middle; the next begins `overlap` before, but later than this one."""
    text, out, start = text.strip(), [], 0
    while start < len(text):
        stop = start + size
        if stop >= len(text):
            out.append(text[start:])
            break
        natural = max(text.rfind("\n", start, stop), text.rfind(" ", start, stop))
        stop = natural if natural - start > size // 2 else stop
        out.append(text[start:stop])
        start = max(start + 1, stop - overlap)
    return out


def table_text(header: list[str], rows: list[list[str]], size: int) -> list[str]:
    """Rows as `column：value` lines under a line of the columns, which each chunk repeats; no rows, no chunks."""
    head, out, lines = "表格列：" + "；".join(header), [], []
    length = len(head)
    for row in rows:
        line = "表格行：" + "；".join(f"{header[i] if i < len(header) else f'列{i + 1}'}：{v}" for i, v in enumerate(row))
        if lines and length + 1 + len(line) > size:
            out.append("\n".join([head, *lines]))
            lines, length = [], len(head)
        lines.append(line)
        length += 1 + len(line)
    return [*out, "\n".join([head, *lines])] if lines else out


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def is_rule(line: str) -> bool:
    found = cells(line)
    return len(found) > 1 and all(re.fullmatch(":?-{3,}:?", c) for c in found)


HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*")


def markdown(text: str, size: int = DEFAULT, overlap: int = DEFAULT_OVERLAP) -> list[Piece]:
    """Sections at headings outside fences, named by the path of headings; tables in them by rows, the rest by windows."""
    out: list[Piece] = []
    path: list[Piece] = []  # marks and title
    fenced, ref, lines = False, "document", []

    def close() -> None:
        own = "\n".join(lines).strip().splitlines()
        prose, tables, i = [], 0, 0

        def flush() -> None:
            out.extend((w, ref) for w in windows("\n".join(prose), size, overlap))
            prose.clear()

        while i < len(own):
            if "|" in own[i] and i + 1 < len(own) and is_rule(own[i + 1]):
                flush()
                tables, stop = tables + 1, i + 2
                while stop < len(own) and "|" in own[stop]:
                    stop += 1
                out.extend((t, f"{ref}#table-{tables}") for t in table_text(cells(own[i]), [cells(x) for x in own[i + 2 : stop]], size))
                i = stop
            else:
                prose.append(own[i])
                i += 1
        flush()

    for line in text.splitlines():
        if line.strip()[:3] in ("```", "~~~"):
            fenced = not fenced
        m = None if fenced else HEADING.fullmatch(line)
        if m:
            close()
            path = [p for p in path if len(p[0]) < len(m[1])] + [(m[1], m[2].strip().rstrip("#").strip())]
            ref, lines = " > ".join(p[1] for p in path), []
        lines.append(line)
    close()
    return out


# How definitions begin in the languages that are not parsed.
SCRIPT = r"^\s*(?:export\s+)?(?:async\s+)?function\s+([\w$]+)|^\s*(?:export\s+)?class\s+([\w$]+)"
DEFINITIONS = {
    "js": SCRIPT, "jsx": SCRIPT, "ts": SCRIPT, "tsx": SCRIPT,
    "java": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+(\w+)",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)",
}


def defined(text: str, pattern: str, size: int = DEFAULT, overlap: int = DEFAULT_OVERLAP) -> list[Piece]:
    """A chunk from each line that begins a definition to the next; what is before the first is the preamble."""
    lines = text.splitlines()
    begins = [(i, next(g for g in m.groups() if g)) for i, line in enumerate(lines) if (m := re.search(pattern, line))]
    if not begins:
        return [(w, "code") for w in windows(text, size, overlap)]
    if begins[0][0]:
        begins.insert(0, (0, "module preamble"))
    stops = [b[0] for b in begins[1:]] + [len(lines)]
    return [(w, name) for (i, name), stop in zip(begins, stops) for w in windows("\n".join(lines[i:stop]), size, overlap)]


def python(text: str, size: int = DEFAULT, overlap: int = DEFAULT_OVERLAP) -> list[Piece]:
    """Methods under their class's header, other classes and functions whole, and all lines of the module outside them.

    No line is lost: statements between definitions belong to the preamble, class attributes to the class's header.
    """
    try:
        body = ast.parse(text).body
    except SyntaxError:
        return [(w, "code") for w in windows(text, size, overlap)]
    lines, out, taken = text.splitlines(), [], set()
    first = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
    functions, wholes = (ast.FunctionDef, ast.AsyncFunctionDef), []
    for node in body:
        if not isinstance(node, (*functions, ast.ClassDef)):
            continue
        own = range(first(node), node.end_lineno)
        taken.update(own)
        methods = [n for n in node.body if isinstance(n, functions)] if isinstance(node, ast.ClassDef) else []
        inside = {i for n in methods for i in range(first(n), n.end_lineno)}
        header = "\n".join(lines[i] for i in own if i not in inside).strip()
        for n in methods:
            out += [(w, f"class {node.name}.{n.name}") for w in windows(header + "\n" + "\n".join(lines[first(n) : n.end_lineno]).strip(), size, overlap)]
        if not methods:
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            wholes += [(w, f"{kind} {node.name}") for w in windows("\n".join(lines[own.start : own.stop]), size, overlap)]
    rest = "\n".join(line for i, line in enumerate(lines) if i not in taken)
    if not taken:
        return [(w, "module") for w in windows(rest, size, overlap)]
    return [(w, "module preamble") for w in windows(rest, size, overlap)] + out + wholes


def by_suffix(text: str, suffix: str, size: int = DEFAULT, overlap: int = DEFAULT_OVERLAP) -> list[Piece]:
    suffix = suffix.lower().lstrip(".")
    if suffix in ("md", "markdown"):
        return markdown(text, size, overlap)
    if suffix == "py":
        return python(text, size, overlap)
    if suffix in DEFINITIONS:
        return defined(text, DEFINITIONS[suffix], size, overlap)
    return [(w, "text") for w in windows(text, size, overlap)]


#: Texts of a batch whose pieces a worker holds at a time.
TEXTS_AT_ONCE = 128


def exploded(df: DataFrame, split: Callable[..., list[Piece]], keys: list[str], inputs: list[str]) -> DataFrame:
    """A row (keys, chunk_index, ref, content) for each piece that split(*inputs) gives; null inputs count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            args = [batch.column(n).to_pylist() for n in inputs]
            rows, nth, ref, content = [], [], [], []
            for i, values in enumerate(zip(*args)):
                for k, (text, name) in enumerate(split(*[v or "" for v in values])):
                    rows.append(i)
                    nth.append(k)
                    ref.append(name)
                    content.append(text)
            kept = [batch.column(n).take(pa.array(rows, pa.int64())) for n in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nth, pa.int32()), pa.array(ref, pa.string()), pa.array(content, pa.string())], [*keys, "chunk_index", "ref", "content"])

    types = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in keys)
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, f"{types}, chunk_index int, ref string, content string")


def split_windows(docs: DataFrame, size: int = CHILD, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """docs (doc_id, text): doc_id, chunk_index, content, char_count."""
    pieces = exploded(docs, lambda text: [(w, "") for w in windows(text, size, overlap)], ["doc_id"], ["text"])
    return pieces.select("doc_id", "chunk_index", "content", F.length("content").alias("char_count"))


def parent_child(docs: DataFrame, parent: int = PARENT, child: int = CHILD, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Parents without overlap and their children: doc_id, parent_index, child_index (null: the parent itself),
    chunk_level, content, char_count."""

    def both(text: str) -> list[Piece]:
        out = []
        for p, whole in enumerate(windows(text, parent, 0)):
            out.append((whole, f"{p}/"))
            out += [(w, f"{p}/{c}") for c, w in enumerate(windows(whole, child, overlap))]
        return out

    pieces = exploded(docs, both, ["doc_id"], ["text"]).withColumn("at", F.split("ref", "/"))
    return pieces.select(
        "doc_id", F.col("at")[0].cast("int").alias("parent_index"), F.expr("try_cast(at[1] as int)").alias("child_index"),
        F.when(F.col("at")[1] == "", "parent").otherwise("child").alias("chunk_level"), "content", F.length("content").alias("char_count"),
    )
