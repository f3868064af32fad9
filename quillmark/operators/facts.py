"""Code facts: extraction from sources and configuration, resolution of names, attachment to symbols, links, components."""

from __future__ import annotations

import ast
import heapq
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmark.functions.text import identity, is_config_path
from quillmark.operators.running import key_of
from quillmark.operators.yamls import COMPOSE_FILES, config_facts  # noqa: F401
from quillmark.session import cut, spread

# Languages by suffix, the rules of components, and which facts a configured name is matched with.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
COMPONENTS = [
    ("FastAPI", "web_framework", [r"fastapi", r"FastAPI\s*\(", r"@(?:app|router)\.(?:get|post|put|delete)"]),
    ("PostgreSQL", "database", [r"postgresql", r"psycopg", r"DATABASE_URL"]),
    ("pgvector", "vector_store", [r"pgvector", r"vector\(", r"CREATE EXTENSION IF NOT EXISTS vector"]),
    ("SSE", "transport", [r"text/event-stream", r"StreamingResponse", r"event:"]),
    ("OpenAI-compatible API", "model_api", [r"chat\.completions", r"embeddings\.create", r"LLM_API_BASE"]),
]
RESOURCES = {"kafka_topic_config": ["kafka_topic_producer", "kafka_topic_consumer"], "mongo_collection": ["mongo_collection"]}

#: Bits of the lines of a sweep's smallest tiles, how many more the next have, and how many sizes there are before the last.
TILE_BITS, LEVEL_BITS, LEVELS = 12, 5, 9

SYMBOL = "path string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, parent string, docstring string"
RELATION = "path string, source string, relation_type string, target_ref string, line int, confidence double"


def _dotted(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    parts = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *parts] if isinstance(node, ast.Name) else parts) or "unknown"


def python_facts(source: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols (name, qualified, kind, signature, start, end, parent, docstring) and relations (source, type, target,
    line, confidence) of a module; raises SyntaxError."""
    lines, symbols, relations = source.splitlines(), [], []
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(ast.parse(source), ())]
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function"}[type(node)]
            inner = (*scope, node.name)
            symbols.append((node.name, ".".join(inner), kind, lines[node.lineno - 1].strip(), node.lineno, node.end_lineno, ".".join(scope) or None, ast.get_docstring(node)))
        elif isinstance(node, ast.Import):
            relations += [("file", "imports", a.name, node.lineno, 1.0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            relations += [("file", "imports", f"{'.' * node.level}{node.module or ''}:{a.name}", node.lineno, 1.0) for a in node.names]
        elif isinstance(node, ast.Call):
            relations.append((".".join(scope) or "file", "calls", _dotted(node.func), node.lineno, 0.85))
        todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, relations


# Definitions and imports where there is no parser.
GENERIC = [
    (re.compile(r"\b(?:class|interface|struct)\s+([A-Za-z_$][\w$]*)"), "class"),
    (re.compile(r"\b(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("), "function"),
    (re.compile(r"\b(?:public|private|protected|static|func|def|void|int|string|boolean|\w+)\s+([A-Za-z_$][\w$]*)\s*\([^\n]*\)"), "function"),
]
GENERIC_IMPORT = re.compile(r"^\s*(?:import|from)\s+([^;]+)", re.M)


def generic_facts(source: str, warning: str | None = None) -> tuple[list[tuple], list[tuple]]:
    lines = source.split("\n")
    at = lambda m: source.count("\n", 0, m.start()) + 1
    symbols = [(m[1], m[1], kind, lines[at(m) - 1].strip(), at(m), at(m), None, None) for pattern, kind in GENERIC for m in pattern.finditer(source)]
    relations = [("file", "imports", m[1].strip(), i, 0.65) for i, line in enumerate(lines, 1) if (m := GENERIC_IMPORT.match(line))]
    return symbols, relations + ([("file", "parse_warning", warning, 1, 1.0)] if warning else [])


#: Our own patterns of Go: what is no code, definitions, imports, calls and words that only look like calls.
GO_QUIET = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', re.S)
GO_DEFINED = re.compile(r"^(?:func\s+(?P<receiver>\([^)]*\)\s*)?(?P<func>[A-Za-z_]\w*)|[ \t]*(?:type\s+)?(?P<type>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?:struct|interface)\b|type\s+(?P<other>[A-Za-z_]\w*)\s+[\w*\[(])", re.M)
GO_IMPORTED = re.compile(r'^import\s+(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]+))', re.M)
GO_CALLED = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")
GO_WORDS = {"func", "if", "for", "switch", "return", "select", "go", "defer", "range", "type", "import", "var", "const", "interface", "struct", "map", "chan"}


def go_facts(source: str) -> tuple[list[tuple], list[tuple]]:
    """As python_facts: functions, methods and types with the lines of their braces, imports (0.9) and calls (0.8) with
    the definition around them. Texts and comments are blanked out first, so braces in them count for nothing."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code, lines = GO_QUIET.sub(blank, source), source.split("\n")
    number = lambda at: code.count("\n", 0, at) + 1
    to: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            to[opened.pop()] = m.start()
    symbols, spans = [], []
    for m in GO_DEFINED.finditer(code):
        name = m["func"] or m["type"] or m["other"]
        line_end = code.find("\n", m.end())
        brace = code.find("{", m.start(), line_end if line_end >= 0 else len(code))
        end = to.get(brace, m.end())
        kind = "method" if m["receiver"] else "function" if m["func"] else "type"
        first = number(m.start() + len(m[0]) - len(m[0].lstrip()))
        outer = [n for a, b, n in spans if a < m.start() < b]
        symbols.append((name, ".".join([*outer, name]), kind, lines[first - 1].strip(), first, number(end), ".".join(outer) or None, None))
        spans.append((m.start(), end, name))
    scope = lambda at: ".".join(n for a, b, n in spans if a < at <= b) or "file"
    relations = [("file", "imports", source[m.start() : m.end()].strip(), number(m.start()), 0.9) for m in GO_IMPORTED.finditer(code)]
    heads = {m.end(g) for m in GO_DEFINED.finditer(code) for g in ("func",) if m[g]}
    relations += [(scope(m.start()), "calls", m[1], number(m.start()), 0.8) for m in GO_CALLED.finditer(code) if m[1] not in GO_WORDS and m.end(1) not in heads]
    return symbols, relations


def file_facts(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of one file by its suffix, the file itself first; they have the columns of SYMBOL and RELATION
    after the path. Of symbols with one qualified name and line the first counts."""
    suffix = path.rpartition(".")[2].lower()
    try:
        found = python_facts(source) if suffix == "py" else go_facts(source) if suffix == "go" else generic_facts(source)
    except (SyntaxError, ValueError):
        found = generic_facts(source, "python_syntax_error")
    n = max(1, len(source.splitlines()))
    first = {(s[1], s[4]): s for s in reversed(found[0])}
    return [(path, "file", "file", None, 1, n, None, None), *sorted(first.values(), key=lambda s: (s[4], s[1]))], found[1]


def extract(sources: DataFrame) -> DataFrame:
    """sources (path, content): rows (record, symbol struct, relation struct) of all files, Arrow-batched; split them
    with `symbols` and `relations`. Of symbols with one qualified name and line the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols, relations = file_facts(path or "", source or "")
                out += [("symbol", path, *s, None, None, None, None, None) for s in symbols]
                out += [("relation", path, *[None] * 8, *r) for r in relations]
            names = ["record", "path", "name", "qualified_name", "kind", "signature", "start_line", "end_line", "parent", "docstring", "source", "relation_type", "target_ref", "line", "confidence"]
            types = [pa.string()] * 6 + [pa.int32(), pa.int32()] + [pa.string()] * 5 + [pa.int32(), pa.float64()]
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = f"record string, {SYMBOL}, {RELATION.replace('path string, ', '')}"
    return spread(sources.select(F.col("path").cast("string"), F.col("content").cast("string")), "path").mapInArrow(run, schema)


def symbols(extracted: DataFrame) -> DataFrame:
    return extracted.filter("record = 'symbol'").select(*[c.split()[0] for c in SYMBOL.split(", ")])


def relations(extracted: DataFrame) -> DataFrame:
    return extracted.filter("record = 'relation'").select(*[c.split()[0] for c in RELATION.split(", ")])


def components(files: DataFrame, project: str) -> DataFrame:
    """files (project, path, content): a row for each component of a project with the files that show it. The rules
    are expressions, evaluated in one pass over the text."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.filter(F.array(*[F.when(F.col("content").rlike("(?i)" + p), p) for p in ps]), lambda p: p.isNotNull()).alias("patterns")) for n, c, ps in COMPONENTS])
    docker = F.struct(F.lit("Docker").alias("name"), F.lit("deployment").alias("category"), F.when(F.lower(F.element_at(F.split("path", "/"), -1)).isin("dockerfile", *COMPOSE_FILES), F.array(F.lit("deployment_file"))).otherwise(F.array().cast("array<string>")).alias("patterns"))
    hits = files.select(project, "path", F.explode(F.array_append(rules, docker)).alias("r")).filter(F.size("r.patterns") > 0)
    confidence = F.round(F.least(F.lit(0.99), F.lit(0.65) + F.lit(0.1) * F.count("*")), 6)
    return hits.groupBy(project, F.col("r.name").alias("name"), F.col("r.category").alias("category")).agg(confidence.alias("confidence"), F.count("*").alias("n_files"))


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """points (keys, point_id, line) with the narrowest interval (keys, symbol_id, start_line, end_line) around them,
    of equal ones the latest start, then the least id; null if there is none. A key with null matches nothing."""
    return around(points, intervals, keys, (F.col("end_line").cast("long") - F.col("start_line"), -F.col("start_line")), line)


def around(points: DataFrame, intervals: DataFrame, keys: list[str], order: tuple[Column, Column], line: str = "line") -> DataFrame:
    """points with the interval around them that comes first in the order, then by its id.

    Lines are cut into tiles, wide enough that an interval touches two at most: intervals of very different lengths have
    tiles of their own, LEVEL_BITS apart, and a point is met at each level that occurs. In a tile starts and points pass in
    order of their lines, and a heap holds the intervals that are open; those that have ended are dropped when they come to
    its top. So a key with very many rows is swept by many tasks, also where intervals are open all along.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    symbol, point = intervals.schema["symbol_id"].dataType, points.schema["point_id"].dataType
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    level = F.coalesce(*[F.when(end - start < 1 << TILE_BITS + LEVEL_BITS * i, i) for i in range(LEVELS)], F.lit(LEVELS))
    tile = lambda at: F.expr(f"shiftright({at}, {TILE_BITS} + {LEVEL_BITS} * _level)")
    spans = intervals.filter(known & (start <= end)).select(key_of(*keys).alias("_key"), level.alias("_level"), start.alias("_start"), end.alias("_end"), *[c.cast("long").alias(n) for c, n in zip(order, ("_a", "_b"))], "symbol_id")
    spans = cut(spans)  # read for the levels and for the sweep
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())
    if not levels:
        return points.withColumn("symbol_id", F.lit(None).cast(symbol))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    starts = spans.withColumn("_tile", F.explode(F.array_distinct(F.array(tile("_start"), tile("_end"))))).select("_key", "_level", "_tile", (F.col("_start") * 2).alias("_at"), "_end", "_a", "_b", "symbol_id", none(point, "point_id"))
    spots = points.filter(known & F.col(line).isNotNull()).select(key_of(*keys).alias("_key"), F.col(line).cast("long").alias("_line"), "point_id", F.explode(F.array(*map(F.lit, levels))).alias("_level"))
    spots = spots.select("_key", "_level", tile("_line").alias("_tile"), (F.col("_line") * 2 + 1).alias("_at"), *[none("long", n) for n in ("_end", "_a", "_b")], none(symbol, "symbol_id"), "point_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, []
        for batch in batches:
            found = []
            for k, lev, part, place, end, a, b, symbol, point in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, lev, k) != at:
                    at, open_ = (part, lev, k), []
                if point is None:
                    heapq.heappush(open_, (a, b, symbol, end))
                    continue
                while open_ and open_[0][3] < place >> 1:
                    heapq.heappop(open_)
                if open_:
                    found.append((point, *open_[0][:3]))
            cols = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["point_id", "_a", "_b", "symbol_id"])

    kinds = [to_arrow_type(point), pa.int64(), pa.int64(), to_arrow_type(symbol)]
    swept = spread(starts.unionByName(spots), "_key", "_level", "_tile").sortWithinPartitions("_key", "_level", "_tile", "_at")
    best = swept.mapInArrow(run, f"point_id {point.simpleString()}, _a long, _b long, symbol_id {symbol.simpleString()}")
    if len(levels) > 1:
        best = best.groupBy("point_id").agg(F.min(F.struct("_a", "_b", "symbol_id")).alias("_best")).select("point_id", "_best.symbol_id")
    return points.join(best.select("point_id", "symbol_id"), "point_id", "left")


def resolve(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relations (relation_id, target_key or null, target_ref) with target_id: the exact key's symbol, else the first
    of that short name, else the first of that full name; symbols (symbol_id, key, name, qualified_name, ordinal)."""
    exact = symbols.groupBy(F.col("key").alias("target_key")).agg(F.max_by("symbol_id", "ordinal").alias("by_key"))
    short = symbols.groupBy(F.col("name").alias("target_ref")).agg(F.min_by("symbol_id", "ordinal").alias("by_name"))
    full = symbols.groupBy(F.col("qualified_name").alias("target_ref")).agg(F.min_by("symbol_id", "ordinal").alias("by_full"))
    return relations.join(exact, "target_key", "left").join(short, "target_ref", "left").join(full, "target_ref", "left").withColumn("target_id", F.coalesce("by_key", "by_name", "by_full")).drop("by_key", "by_name", "by_full")


def links(facts: DataFrame) -> DataFrame:
    """facts (fact_id, fact_type, name, value, path): source_id, target_id, relation_type, confidence, by equi-joins.

    A fact makes rows for each side of each relation that it can have: all of them in one pass, short ones.
    Sides and pairs are dealt over a given number of tasks, as the parts that adaptive execution joins would be as large as
    memory allows; all pairs of one key are made, not held, by one task. Pairs that several facts of one id make are one;
    sorting finds them, since a map of all pairs would be held."""
    f = facts.withColumn("identity", identity(F.col("fact_type"), F.col("name"), F.col("value"))).withColumn("config", is_config_path(F.col("path"))).withColumn("resource", F.lower(F.trim(F.when(F.col("value") == "", F.col("name")).otherwise(F.coalesce("value", "name")))))
    kind, config = F.col("fact_type"), F.col("config")
    side = lambda when, relation, *on: F.when(when, F.struct(F.lit(relation).cast("byte").alias("relation"), *[c.alias(n) for c, n in zip(on, ("a", "b"))]))
    none = F.lit("")
    called = lambda fact_type: side((kind == fact_type) & F.col("path").isNotNull() & F.col("value").isNotNull(), 0, F.col("path"), F.col("value"))
    resource = lambda when, use: side(when & (F.col("resource") != ""), 2, use, F.col("resource"))
    named = side(kind.isin("downstream_grpc", "endpoint_config") & config & (F.col("identity") != ""), 1, F.col("identity"), none)
    inits = side((kind == "client_initialization") & (F.col("identity") != ""), 1, F.col("identity"), none)
    asks = [called("client_initialization"), named, *[resource((kind == k) & config, F.lit(use)) for k, uses in RESOURCES.items() for use in uses]]
    says = [called("downstream_call"), inits, resource(kind.isin(*{use for uses in RESOURCES.values() for use in uses}) & ~config, kind)]
    rows = lambda sides, id_: spread(f.select(F.col("fact_id").alias(id_), F.inline(F.array_compact(F.array(*sides)))), "relation", "a", "b")
    pairs = rows(asks, "source_id").join(rows(says, "target_id"), ["relation", "a", "b"]).filter("source_id <> target_id").select("source_id", "target_id", "relation")
    pairs = first_seen(spread(pairs, "source_id", "target_id"), ["source_id", "target_id", "relation"], "relation")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("relation").cast("int"))
    return pairs.select("source_id", "target_id", of(["client_invokes", "configures_client", "configures_usage"]).alias("relation_type"), of([0.96, 0.9, 0.98]).alias("confidence"))


def first_seen(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key. Rows that the order leaves equal are interchangeable: end it with the place in the source."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def scip_lines(range_: Column) -> Column:
    """0-based half-open ranges of 3 or 4 ints as 1-based lines: struct<start, stop>."""
    at = lambda i: F.get(range_, F.lit(i))
    four = F.size(range_) == 4
    stop = F.when(four & (at(3) == 0) & (at(2) > at(0)), at(2)).when(four, at(2) + 1).otherwise(at(0) + 1)
    return F.when(F.size(range_).isin(3, 4), F.struct((at(0) + 1).alias("start"), stop.alias("stop"))).otherwise(F.struct(F.lit(1).alias("start"), F.lit(1).alias("stop")))
