"""YAML files as a table of their nodes, which the configuration rules are derived from by filters and joins.

One row for each node below the root: its keys from the root (positions in sequences are keys too), the names among them
(without positions), what it is, its text, and the lines of its value, its own key and its parent's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import redact_named
from quillmark.session import cut, spread

NODE = "path string, nth int, keys array<string>, names array<string>, kind string, value string, line int, key_line int, parent_line int"
# How Compose files are called, and the fields of a service that are facts.
COMPOSE_FILES = ["compose.yml", "compose.yaml", "docker-compose.yml", "docker-compose.yaml"]
COMPOSE_FIELDS = ["image", "build", "ports", "environment", "depends_on", "networks", "volumes"]
#: The parser in C gives the same nodes in a fraction of the time; not every build of the library has it.
LOADER = getattr(yaml, "CLoader", yaml.Loader)
#: Containers up to this depth get their content as text.
SHOWN = 3


def children(node: yaml.Node) -> list[tuple[str, yaml.Node, int | None]]:
    """Key, value and line of the key of a container's entries (no line of its own for those of a sequence)."""
    if isinstance(node, yaml.MappingNode):
        return [(str(k.value), v, k.start_mark.line + 1) for k, v in node.value]
    return [(str(i), v, None) for i, v in enumerate(node.value)] if isinstance(node, yaml.SequenceNode) else []


def content(node: yaml.Node) -> str | None:
    try:
        return str(yaml.constructor.SafeConstructor().construct_document(node))
    except yaml.YAMLError:
        return None


def node_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        root = yaml.compose(text, LOADER)
    except yaml.YAMLError:
        yield path, 0, [], [], "error", None, 1, 1, 1
        return
    stack = [iter([([], [], child, 1) for child in ([root] if root is not None else [])])]
    nth = 0
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        keys, names, node, own_line = step
        below = []
        for key, child, line in children(node):
            below.append(([*keys, key], names if line is None else [*names, key], child, line or own_line))
        for k, n, child, line in below:
            kind = "mapping" if isinstance(child, yaml.MappingNode) else "list" if isinstance(child, yaml.SequenceNode) else "scalar"
            shown = str(child.value) if kind == "scalar" else content(child) if len(k) <= SHOWN else None
            nth += 1
            yield path, nth, k, n, kind, shown, child.start_mark.line + 1, line, own_line
        stack.append(iter([x for x in below if not isinstance(x[2], yaml.ScalarNode)]))


def nodes(files: DataFrame) -> DataFrame:
    """files (path, content): NODE rows; a file that can't be read gives one row of kind `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODE.split(", ")]
        types = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            found = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in node_rows(p or "", t or "")]
            cols = list(zip(*found)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return spread(files.select(F.col("path").cast("string"), F.col("content").cast("string")), "path").mapInArrow(run, NODE)


def dialect(path: Column) -> Column:
    """compose, values, helm (templates and further values files) or yaml, by name and folder; null for other files."""
    name, low = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    helm = F.endswith(name, F.lit("-values.yaml")) | F.contains(low, F.lit("/templates/"))
    return F.when(name.rlike(r"\.ya?ml$"), F.when(name.isin(COMPOSE_FILES), "compose").when(name == "values.yaml", "values").when(helm, "helm").otherwise("yaml"))


def template_facts(files: DataFrame) -> DataFrame:
    """What Helm files say outside YAML: references to values and kinds of resources, line by line."""
    lines = files.filter(F.col("dialect").isin("helm", "values")).select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    every = lambda pattern: F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("value")
    row = lambda key, how, status: [F.lit("helm-template").alias("parser_name"), F.lit("helm_template").alias("config_format"), F.lit("helm_template").alias("fact_type"), F.lit(key).alias("key_path"), "value", F.lit(how).alias("value_kind"), F.lit(status).alias("parse_status")]
    used = lines.select("path", "line", every(r"\{\{\s*\.Values\.([A-Za-z0-9_.-]+)")).select("path", "line", *row("helm.Values", "template", "partial"))
    kinds = lines.select("path", "line", every(r"^\s*kind:\s*([A-Za-z0-9]+)")).select("path", "line", *row("kubernetes.kind", "scalar", "parsed"))
    return used.union(kinds)


def config_facts(files: DataFrame) -> DataFrame:
    """files (path, content): path, line, parser_name, config_format, fact_type, key_path, value, value_kind,
    parse_status, values hidden by the name of their key. Compose services and their fields, and what Helm templates
    use, come beside the plain keys. Other files than YAML give no rows."""
    own = files.select("path", F.col("content").cast("string").alias("content"), dialect(F.col("path")).alias("dialect")).filter("dialect is not null")
    tree = cut(nodes(own.select("path", "content"))).withColumn("dialect", dialect(F.col("path")))  # read five times
    said = lambda parser, fmt, fact, key, value, how, status="parsed": [F.lit(x).alias(n) if isinstance(x, str) else x.alias(n) for n, x in zip(("parser_name", "config_format", "fact_type", "key_path", "value", "value_kind", "parse_status"), (parser, fmt, fact, key, value, how, status))]
    of_values, of_compose = F.col("dialect") == "values", F.col("dialect") == "compose"
    broken = tree.filter("kind = 'error'").select("path", "line", *said(F.when(of_compose, "docker-compose").when(of_values, "helm-values").otherwise("yaml"), F.when(of_compose, "docker_compose").when(of_values, "helm_values").otherwise("yaml"), F.when(of_values, "helm_value").otherwise("parse_error"), "$", F.when(of_compose, "Compose parse failed").otherwise("YAML parse failed"), "error", "partial"))
    plain = tree.filter("kind = 'scalar'").select("path", "line", *said(F.when(of_values, "helm-values").otherwise("yaml"), F.when(of_values, "helm_values").otherwise("yaml"), F.when(of_values, "helm_value").otherwise("config_key"), F.array_join("keys", "."), F.col("value"), "scalar"))
    key = lambda i: F.get("keys", F.lit(i))
    depth, base = F.size("keys"), F.concat(F.lit("services."), key(1))
    service = tree.filter(of_compose & (key(0) == "services") & (F.size("names") >= 2))
    named = service.filter(depth == 2).select("path", F.col("key_line").alias("line"), *said("docker-compose", "docker_compose", "service", base, key(1), "scalar"))
    fields = service.filter((depth == 3) & key(2).isin(COMPOSE_FIELDS)).select("path", F.col("key_line").alias("line"), *said("docker-compose", "docker_compose", F.concat(F.lit("compose_"), key(2)), F.concat(base, F.lit("."), key(2)), F.col("value"), F.col("kind")))
    needs = service.filter((depth == 4) & (key(2) == "depends_on")).select("path", F.col("parent_line").alias("line"), *said("docker-compose", "docker_compose", "dependency", base, F.when(F.size("names") == 4, key(3)).otherwise(F.col("value")), "scalar"))
    every = plain
    for part in (broken, named, fields, needs, template_facts(own)):
        every = every.unionByName(part)
    return every.withColumn("value", redact_named(F.col("key_path"), F.col("value")))
