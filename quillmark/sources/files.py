"""File sources: trees of sources and configuration, inventories, evaluation cases, ranges of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import inventory_role, is_config_path, sha256
from quillmark.operators.facts import LANGUAGES

# Folders that are not looked into and files that are generated.
IGNORED = {".git", ".venv", "venv", "node_modules", "dist", "build", "target", "__pycache__"}
GENERATED = r"(_pb2\.py|_pb2_grpc\.py|\.pb\.go|\.min\.js|\.d\.ts)$"
LARGEST_CONFIG, MOST_FACTS = 2 * 1024 * 1024, 20_000
SPAN, MOST_LINES = 120, 200


def tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below root, whatever file system it is in: path (relative), content (binary), size_bytes. Only the
    columns asked for are read: without content, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    own = F.regexp_replace(F.col("path"), "^[a-zA-Z]+:/*(?=/)", "")
    return files.select(F.substring(own, F.instr(own, F.lit(base)) + len(base) + 1, F.lit(1 << 20)).alias("path"), "content", F.col("length").alias("size_bytes"))


def folders(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def looked_into(path: Column) -> Column:
    return ~F.arrays_overlap(folders(path), F.array(*map(F.lit, sorted(IGNORED))))


def text_of(content: Column) -> Column:
    """UTF-8 with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def readable_text(content: Column) -> Column:
    """UTF-8 with bad bytes left out, as documents are read (no built-in does; Arrow batches)."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))

    return text(content)


def documents(files: DataFrame) -> DataFrame:
    """files (path, content binary) as documents: path, suffix, text, content_hash."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", suffix.alias("suffix"), readable_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash"))


def sources(files: DataFrame) -> DataFrame:
    """Source files in languages that facts are extracted from: path, language, content."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]), suffix)
    return files.filter(looked_into(F.col("path")) & suffix.isin(*LANGUAGES) & ~F.lower("path").rlike(GENERATED)).select("path", language.alias("language"), text_of(F.col("content")).alias("content"))


def config_files(files: DataFrame) -> DataFrame:
    return files.filter(looked_into(F.col("path")) & F.lower("path").rlike(r"\.ya?ml$") & (F.col("size_bytes") <= LARGEST_CONFIG)).select("path", text_of(F.col("content")).alias("content"))


def inventory(files: DataFrame) -> DataFrame:
    """Every file that is looked into: path, extension, role, language, size, lines, hash, parser status."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = text_of(F.col("content"))
    language = F.try_element_at(F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]), suffix)
    status = F.when(language.isNotNull() | suffix.isin("yaml", "yml"), "parsed").when(is_config_path(F.col("path")), "inventoried").otherwise("unsupported")
    lines = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\n")))
    return files.filter(looked_into(F.col("path"))).select("path", suffix.alias("extension"), inventory_role(F.col("path")).alias("role"), language.alias("language"), "size_bytes", lines.alias("line_count"), F.sha2("content", 256).alias("content_hash"), status.alias("parser_status"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("parser_status").agg(F.count("*").alias("n_files"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line; blank lines are skipped."""
    schema = "id string, question string, expected_route string, expected_source_terms array<string>, required_terms array<string>, answer_terms array<string>, citation_source_terms array<string>, difficulty string, evaluation_type string, should_refuse boolean"
    return spark.read.schema(schema).json(path)


def line_range(texts: DataFrame, start: int = 1, stop: int | None = None, expected_hash: str | None = None) -> DataFrame:
    """texts (path, content): the numbered lines from start to stop, SPAN by default and MOST_LINES at most. With a
    hash, a text that has another one fails the query, and so does a range outside the file."""
    first = max(1, start)
    last = min(stop or first + SPAN - 1, first + MOST_LINES - 1)
    rows = texts.filter(F.assert_true(sha256(F.col("content")) == expected_hash, F.lit("content has changed")).isNull()) if expected_hash else texts
    inside = F.assert_true((F.size(F.split("content", r"\r?\n")) >= first) & F.lit(last >= first), F.lit("line range is outside the file"))
    rows = rows.filter(inside.isNull())
    return rows.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1).filter(F.col("line").between(first, last))
