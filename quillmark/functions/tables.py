"""Splitters and extractors as table functions that SQL can call, after `register(spark)`:

    SELECT doc_id, ref, content FROM split_markdown(TABLE(documents), text => 'text')
    SELECT * FROM code_symbols(TABLE(sources), path => 'path', text => 'content') WHERE kind = 'method'
    SELECT doc_id, count(*) FROM split_windows(TABLE(documents) PARTITION BY doc_id, text => 'text', size => 700, overlap => 100) GROUP BY doc_id

All columns of the table but the text go along; one that is named as a made column gives way to it. Null texts count as
empty. Rows are split one by one, so no partitioning is needed; with PARTITION BY they are only dealt anew. The rows go to
and from Python pickled: as Arrow batches each input row's few results would be a batch of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from quillmark.operators import chunking, facts, yamls


@dataclass
class Plan(AnalyzeResult):
    """What analyze found: the columns that go along, the columns of the inputs, the options."""

    along: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    options: tuple[int, ...] = ()


def table_function(rows_of: Callable[..., Iterator[tuple]], made: str, inputs: tuple[str, ...] = ("text",), options: dict[str, int] | None = None):
    """A table function over TABLE(...): inputs name its columns, which rows_of takes, then the options' values; rows_of
    yields the columns of made. Of the inputs only `text` doesn't go along."""
    known, columns = options or {}, StructType.fromDDL(made)

    class Function:
        def __init__(self, plan: Plan) -> None:
            self.plan = plan

        @staticmethod
        def analyze(table: AnalyzeArgument, **said: AnalyzeArgument) -> Plan:
            if not table.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            wrong = set(said) - {*inputs, *known}
            if wrong:
                raise ValueError(f"no argument is called {', '.join(sorted(wrong))}; there are {', '.join([*inputs, *known])}")
            fields = {f.name: f for f in table.dataType.fields}
            named = tuple(said[i].value if i in said else i for i in inputs)
            for argument, name in zip(inputs, named):
                if name not in fields:
                    raise ValueError(f"{argument} => {name!r}: the table has no such column; it has {', '.join(fields)}")
                if fields[name].dataType.simpleString() != "string":
                    raise ValueError(f"{argument} => {name!r}: not a string column")
            values = tuple(said[o].value if o in said else known[o] for o in known)
            for option, value in zip(known, values):
                if not isinstance(value, int) or value < (0 if option == "overlap" else 1):
                    raise ValueError(f"{option} => {value!r}: a constant whole number is needed")
            dropped = {named[inputs.index("text")], *columns.names}
            along = tuple(n for n in fields if n not in dropped)
            return Plan(StructType([*(fields[n] for n in along), *columns.fields]), along=along, inputs=named, options=values)

        def eval(self, table, **said) -> Iterator[tuple]:
            own = tuple(table[n] for n in self.plan.along)
            for row in rows_of(*(table[n] or "" for n in self.plan.inputs), *self.plan.options):
                yield (*own, *row)

    return udtf(Function, useArrow=False)


def window_rows(text: str, size: int, overlap: int) -> Iterator[tuple]:
    for i, w in enumerate(chunking.windows(text, size, overlap)):
        yield i, w, len(w)


def markdown_rows(text: str, size: int, overlap: int) -> Iterator[tuple]:
    for i, (content, ref) in enumerate(chunking.markdown(text, size, overlap)):
        yield i, ref, content


def source_rows(text: str, path: str, size: int, overlap: int) -> Iterator[tuple]:
    for i, (content, ref) in enumerate(chunking.by_suffix(text, path.rpartition(".")[2] if "." in path else "", size, overlap)):
        yield i, ref, content


def parent_rows(text: str, parent: int, child: int, overlap: int) -> Iterator[tuple]:
    for p, whole in enumerate(chunking.windows(text, parent, 0)):
        yield p, None, "parent", whole, len(whole)
        for c, w in enumerate(chunking.windows(whole, child, overlap)):
            yield p, c, "child", w, len(w)


def symbol_rows(text: str, path: str) -> Iterator[tuple]:
    yield from facts.file_facts(path, text)[0]


def relation_rows(text: str, path: str) -> Iterator[tuple]:
    yield from facts.file_facts(path, text)[1]


def yaml_rows(text: str, path: str) -> Iterator[tuple]:
    for row in yamls.node_rows(path, text):
        yield row[1:]


PIECE = "chunk_index int, ref string, content string"
WINDOWS = {"size": chunking.DEFAULT, "overlap": chunking.DEFAULT_OVERLAP}
FUNCTIONS = {
    "split_windows": (window_rows, "chunk_index int, content string, char_count int", ("text",), {"size": chunking.CHILD, "overlap": chunking.CHILD_OVERLAP}),
    "split_markdown": (markdown_rows, PIECE, ("text",), WINDOWS),
    "split_source": (source_rows, PIECE, ("text", "path"), WINDOWS),
    "split_parents": (parent_rows, "parent_index int, child_index int, chunk_level string, content string, char_count int", ("text",), {"parent": chunking.PARENT, "child": chunking.CHILD, "overlap": chunking.CHILD_OVERLAP}),
    "code_symbols": (symbol_rows, facts.SYMBOL.removeprefix("path string, "), ("text", "path"), {}),
    "code_relations": (relation_rows, facts.RELATION.removeprefix("path string, "), ("text", "path"), {}),
    "yaml_nodes": (yaml_rows, yamls.NODE.removeprefix("path string, "), ("text", "path"), {}),
}


def register(spark: SparkSession) -> None:
    for name, parts in FUNCTIONS.items():
        spark.udtf.register(name, table_function(*parts))
