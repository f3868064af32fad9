"""The tools that an investigation may call, over a store under a scope, pinned to one version of one project.

A tool is an entry of TOOLS: what its arguments may be, and a function that gives its tables. Arguments are cut to their
bounds, unknown names and tools are refused; every answer is cut to the number of rows that an answer may have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import listing
from quillmark.store import Scope, Store

# Bounds of arguments and answers.
SYMBOLS, RELATIONS, FACTS, EDGES, UNRESOLVED, NODES, DEPTH, LINES, QUERY = 20, 20, 30, 80, 40, 40, 4, 120, 120

Answer = dict[str, DataFrame]


class Refused(Exception):
    """The call can't be made as it is."""


@dataclass(frozen=True)
class Pinned:
    """What a tool sees: the store under a scope, a project and its version, and the files' texts (path, content)."""

    store: Store
    scope: Scope
    project: object
    commit: str
    texts: DataFrame | None = None


@dataclass(frozen=True)
class Tool:
    run: Callable[..., Answer]
    arguments: dict[str, type]
    needed: tuple[str, ...] = field(default=())


def project_files(at: Pinned, query: str = "", limit: int = 200, offset: int = 0) -> Answer:
    items, about = at.store.inventory(at.scope, at.project, query, limit, offset, at.commit)
    return {"items": items, "about": about}


def search_symbols(at: Pinned, query: str, symbol_kind: str | None = None, file_path: str | None = None) -> Answer:
    found = at.store.symbols(at.scope, at.project, query.strip()[:QUERY], kind=symbol_kind or None, file_path=file_path or None, commit=at.commit, limit=SYMBOLS)
    return {"items": found.select("symbol_id", "name", "qualified_name", F.col("symbol_kind").alias("kind"), "path", "start_line", "end_line")}


def get_symbol(at: Pinned, symbol_id: object) -> Answer:
    found = at.store.symbol(at.scope, symbol_id)
    one = found["symbol"].filter((F.col("project_id") == F.lit(at.project)) & (F.col("commit_hash") == at.commit))
    if one.isEmpty():
        raise Refused("symbol not found in the project")
    return {"symbol": one, "outgoing": found["relations"].limit(RELATIONS), "incoming": found["incoming"].limit(RELATIONS)}


def read_source(at: Pinned, path: str, start_line: int, end_line: int) -> Answer:
    if at.texts is None:
        raise Refused("no texts")
    start = max(1, start_line)
    return {"lines": at.store.source(at.scope, at.project, path.strip(), at.texts, start, min(start + LINES - 1, max(start, end_line)), at.commit)}


def trace_calls(at: Pinned, symbol_id: int, max_depth: int = 3) -> Answer:
    get_symbol(at, symbol_id)
    found, nodes = at.store.call_chain(at.scope, at.project, symbol_id, min(DEPTH, max(1, max_depth)), NODES)
    return {"nodes": nodes, "edges": found.edges.limit(EDGES), "unresolved": found.unresolved.limit(UNRESOLVED)}


def find_architecture(at: Pinned, query: str = "") -> Answer:
    word = query.strip().lower()[:QUERY]
    within = lambda df: df.filter(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])), F.lit(word))) if word else df
    facts, links = at.store.architecture(at.scope, at.project, at.commit)
    order = ["relation_type", "source_name", "target_name", "source_fact_id", "target_fact_id"]
    return {"facts": listing.facts(within(facts)).limit(FACTS), "links": within(links).orderBy(*order).limit(FACTS)}


def find_config(at: Pinned, query: str = "", path_prefix: str = "", fact_types: list | None = None, formats: list | None = None, limit: int = 100, offset: int = 0) -> Answer:
    items, count = at.store.config(at.scope, at.project, query, path_prefix, fact_types, formats, limit, offset, at.commit)
    return {"items": items, "count": count}


def finish(at: Pinned, reason: str, evidence_sufficient: bool) -> Answer:
    """Ends the investigation: one row that says why."""
    return {"finished": at.store["projects"].sparkSession.range(1).select(F.lit(reason).alias("reason"), F.lit(evidence_sufficient).alias("evidence_sufficient"))}


TOOLS = {
    "list_project_files": Tool(project_files, {"query": str, "limit": int, "offset": int}), "search_symbols": Tool(search_symbols, {"query": str, "symbol_kind": str, "file_path": str}, ("query",)),
    "get_symbol": Tool(get_symbol, {"symbol_id": object}, ("symbol_id",)), "read_source": Tool(read_source, {"path": str, "start_line": int, "end_line": int}, ("path", "start_line", "end_line")),
    "trace_call_path": Tool(trace_calls, {"symbol_id": object, "max_depth": int}, ("symbol_id",)), "find_architecture": Tool(find_architecture, {"query": str}, ("query",)),
    "find_config_facts": Tool(find_config, {"query": str, "path_prefix": str, "fact_types": list, "formats": list, "limit": int, "offset": int}), "finish_investigation": Tool(finish, {"reason": str, "evidence_sufficient": bool}, ("reason", "evidence_sufficient")),
}


def call(at: Pinned, name: str, arguments: dict) -> Answer:
    """The tables that a tool answers with; Refused for unknown tools, names, types and what is missing."""
    if not at.commit.strip():
        raise Refused("a version is needed")
    tool = TOOLS.get(name)
    if tool is None:
        raise Refused(f"tool {name} is not allowed")
    missing, unknown = [n for n in tool.needed if n not in arguments], [n for n in arguments if n not in tool.arguments]
    wrong = [n for n, v in arguments.items() if n in tool.arguments and v is not None and not isinstance(v, tool.arguments[n])]
    if missing or unknown or wrong:
        raise Refused(f"arguments of {name}: missing {missing}, unknown {unknown}, of another type {wrong}")
    return tool.run(at, **arguments)
