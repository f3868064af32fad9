"""Scoped reads: lists with optional filters, symbols pinned to a version, links with both roles.

A filter that is not given is left out of the plan, so the scan gets only those that count. Every list has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import has_any
from quillmark.operators.access import page
from quillmark.operators.catalog import with_counts
from quillmark.operators.retrieval import visible

# What a word in an inventory search stands for.
CONFIG_WORDS = ["config", "yaml", "yml", "compose", "helm", "env", "toml", "json", "properties", "cfg", "conf"]
ALIASES = {"配置": CONFIG_WORDS, "配置文件": CONFIG_WORDS, "部署": ["deployment", "compose", "helm", "docker", "kubernetes", "yaml", "yml"], "yaml": ["yaml", "yml"], "yml": ["yaml", "yml"], "compose": ["compose"], "helm": ["helm", "values", "template"], "env": [".env", "env"]}
STATUSES = ["parsed", "partial", "unsupported", "unclassified"]


def matching(rows: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns have these values; None asks for nothing."""
    for column, value in values.items():
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def contains(query: str, *columns: str) -> Column:
    """One of the columns contains the query, whatever its case (% and _ stay wildcards); an empty query matches all."""
    hit = F.lit(not query)
    for c in columns:
        hit = hit | F.ilike(F.col(c), F.lit(f"%{query}%"))
    return hit


def knowledge(documents: DataFrame, chunks: DataFrame, workspace: object, user: str | None, department: str | None, source_type: str | None = None, scope_type: str | None = None) -> DataFrame:
    """The workspace's documents that the user may see, with the number of their child chunks, the latest first."""
    own = matching(documents, workspace_id=workspace, source_type=source_type, scope_type=scope_type).filter(visible(user, department))
    children = chunks.filter("chunk_level = 'child'").select("document_id")
    return with_counts(own, children, "document_id").orderBy(F.desc("imported_at"), "title", "document_id")


def sources(documents: DataFrame) -> DataFrame:
    """The different sources of a workspace's documents."""
    return documents.select("workspace_id", "source_type", "source_path").distinct()


def pinned(projects: DataFrame, project: object, commit: str | None = None) -> DataFrame:
    """The version of a project that is read: the given one, else the current: project_id, commit_hash."""
    return matching(projects, project_id=project).select("project_id", F.coalesce(F.lit(commit), F.col("current_commit")).alias("commit_hash"))


def symbols(projects: DataFrame, symbols_: DataFrame, files: DataFrame, project: object, query: str = "", file_path: str | None = None, kind: str | None = None, commit: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols of one version of a project whose name, full name or path contains the query; exact names first."""
    rows = symbols_.join(pinned(projects, project, commit), ["project_id", "commit_hash"]).join(matching(files, path=file_path).select("file_id", "path"), "file_id")
    rows = matching(rows, symbol_kind=kind).filter(contains(query, "name", "qualified_name", "path"))
    exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    return rows.orderBy(exact, "path", "start_line", F.length("qualified_name"), "symbol_id").limit(limit)


def outgoing(relations: DataFrame, symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """relations with the name, path and id of their target, null where it is not known."""
    target = symbols_.join(files.select("file_id", "path"), "file_id", "left").select(F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("target_name"), F.col("path").alias("target_path"))
    return relations.join(target, "target_symbol_id", "left")


def incoming(relations: DataFrame, symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """relations that have a target, with the name, path and line of their source."""
    source = symbols_.join(files.select("file_id", "path"), "file_id").select(F.col("symbol_id").alias("source_symbol_id"), F.col("name").alias("source_name"), F.col("path").alias("source_path"), F.col("start_line").alias("source_line"))
    return relations.filter("target_symbol_id is not null").join(source, "source_symbol_id")


def facts(facts_: DataFrame) -> DataFrame:
    return facts_.orderBy("fact_type", "name", "source_path", "source_line", "fact_id")


def links(links_: DataFrame, facts_: DataFrame) -> DataFrame:
    """links (source_fact_id, target_fact_id, ...) with both facts' columns, as source_... and target_...; in order of
    relation type and the names of both."""
    columns = [c for c in ("fact_type", "name", "value", "source_path", "source_line", "source_symbol_id") if c in facts_.columns]
    role = lambda p: facts_.select(F.col("fact_id").alias(f"{p}_fact_id"), *[F.col(c).alias(f"{p}_{c.removeprefix('source_')}") for c in columns])
    return links_.join(role("source"), "source_fact_id").join(role("target"), "target_fact_id").orderBy("relation_type", "source_name", "target_name", "source_fact_id", "target_fact_id")


def inventory(files: DataFrame, query: str = "", limit: int = 200, offset: int = 0, order: tuple[str, ...] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """A page of files in which one of the words that the query stands for occurs, and one row on all files: matches,
    offset, limit, has_more, total, and how many have each parser_status."""
    word = query.strip().lower()
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in files.columns]))
    hit = has_any(text, ALIASES.get(word, [word])) if word else F.lit(True)
    low, most = max(0, offset), max(1, min(limit, 200))
    counts = files.agg(F.count_if(hit).alias("matches"), F.count("*").alias("total"), *[F.count_if(F.col("parser_status") == s).alias(s) for s in STATUSES])
    about = counts.select("matches", F.lit(low).alias("offset"), F.lit(most).alias("limit"), (F.col("matches") > low + most).alias("has_more"), "total", *STATUSES)
    return page(files.filter(hit), list(order), most, low), about


def of_repository(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (workspace_id, repository_key) with the project that is registered for them, null if there is none."""
    known = projects.groupBy("workspace_id", "repository_key").agg(F.min("project_id").alias("project_id"))
    return keys.join(known, ["workspace_id", "repository_key"], "left")


def lock_resource(repository_key: Column, project_id: Column) -> Column:
    """What a project's changes lock: its repository, else itself."""
    key = F.lower(F.trim(F.coalesce(repository_key, F.lit(""))))
    return F.when(key != "", F.concat(F.lit("repository:"), key)).otherwise(F.concat(F.lit("project:"), project_id.cast("string")))


def scan_totals(scans: DataFrame, key: str, **counted: DataFrame) -> DataFrame:
    """scans with the number of rows that each of the counted tables has for them, 0 if none: counted before the joins."""
    for name, rows in counted.items():
        scans = scans.join(rows.groupBy(key).agg(F.count("*").alias(f"{name}_count")), key, "left").fillna(0, [f"{name}_count"])
    return scans


def tally(modules: DataFrame, key: str) -> DataFrame:
    """modules (key, status): succeeded, failed and the status of all: succeeded, partial or failed."""
    rows = modules.groupBy(key).agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("status", F.when(F.col("failed") == 0, "succeeded").when(F.col("succeeded") > 0, "partial").otherwise("failed"))
