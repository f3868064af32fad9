"""Merge a code index (occurrences of symbols) into extracted symbols and relations.

Occurrences come as rows, whatever decoded them; `sources.scip` reads the index's binary form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.facts import around, innermost, scip_lines
from quillmark.operators.running import key_of
from quillmark.session import cut

DEFINITION, IMPORT = 1, 2


#: The kinds of index symbols that are symbols of a project.
KINDS = ["class", "constructor", "enum", "field", "function", "interface", "method", "module", "namespace", "package", "struct", "trait", "type", "typealias", "symbol"]


def located(occurrences: DataFrame) -> DataFrame:
    """occurrences (path, symbol, roles, range, enclosing) with 1-based lines, those of the enclosing range (1 to 1 without
    one), and whether they define or import."""
    lines = scip_lines(F.col("range"))
    around = scip_lines(F.coalesce("enclosing", F.array().cast("array<int>")) if "enclosing" in occurrences.columns else F.array().cast("array<int>"))
    role = lambda bit: F.col("roles").bitwiseAND(F.lit(bit)) > 0
    rows = occurrences.filter("symbol <> ''")
    return rows.select("path", "symbol", lines["start"].alias("line"), around["start"].alias("start_line"), F.greatest(around["start"], around["stop"]).alias("end_line"), role(DEFINITION).alias("defines"), role(IMPORT).alias("imports"))


def display_name(symbol: Column, display: Column) -> Column:
    """The indexer's own name, else what a local symbol is called, else the last descriptor without its signature."""
    local = F.regexp_extract(symbol, r"^local (.+)$", 1)
    tail = F.substring_index(F.element_at(F.split(F.regexp_replace(symbol, "[/#.]+$", ""), "[/#.]"), -1), "(", 1)
    return F.coalesce(F.when(display != "", display), F.when(local != "", local), F.when(tail != "", tail), F.lit("unknown"))


def defined(infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each definition of a symbol that has a name and one of KINDS, with the extracted symbol of that name in its file
    around it (the first one), else a new one: path, symbol, line, name, kind, signature, docstring, start_line, end_line
    and symbol_id, and `fresh`. Definitions inside a new symbol of their name are that symbol.

    infos (symbol, kind_name, display_name, signature, documentation), one for each symbol.
    """
    name = display_name(F.col("symbol"), F.coalesce("display_name", F.lit("")))
    found = located(occurrences).filter("defines").join(infos, "symbol").withColumn("name", name).filter(F.col("kind_name").isin(KINDS) & (F.col("name") != "unknown"))
    found = found.select("path", "symbol", "line", "name", F.col("kind_name").alias("kind"), "signature", F.col("documentation").alias("docstring"), "start_line", "end_line")
    found = cut(found)  # read for the places and for the rows
    places = lambda rows: rows.select("path", "name", "line").distinct().withColumn("point_id", key_of("path", "name", "line"))
    have = symbols.filter("kind <> 'file'").select("path", "name", "symbol_id", "start_line", "end_line")
    first = around(places(found), have, ["path", "name"], (F.col("start_line"), F.lit(0))).filter("symbol_id is not null").select("path", "name", "line", F.col("symbol_id").alias("_have"))
    rows = cut(found.join(first, ["path", "name", "line"], "left"))
    new = rows.filter("_have is null").groupBy("path", "name", F.col("line").alias("_line")).agg(F.min("start_line").alias("_a"), F.max("end_line").alias("_b"))
    earlier = new.select("path", "name", F.col("_line").cast("long").alias("symbol_id"), F.greatest("_a", F.col("_line") + 1).alias("start_line"), F.col("_b").alias("end_line"))
    inside = around(places(rows.filter("_have is null")), earlier, ["path", "name"], (F.col("symbol_id"), F.lit(0))).select("path", "name", "line", F.coalesce(F.col("symbol_id").cast(rows.schema["line"].dataType), "line").alias("_line"))
    rows = rows.join(inside, ["path", "name", "line"], "left")
    made = F.xxhash64("path", "name", "_line")
    return rows.select(*found.columns, F.coalesce("_have", made).alias("symbol_id"), (F.col("_have").isNull() & (F.col("line") == F.col("_line"))).alias("fresh"))


def _added(defined: DataFrame) -> DataFrame:
    rows = defined.filter("fresh")
    one = rows.groupBy("symbol_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("symbol_id", "fresh")]), "symbol").alias("r")).select("symbol_id", "r.*")
    return one.select("symbol_id", "path", "name", F.concat("name", F.lit("@"), F.col("line").cast("string")).alias("qualified_name"), "kind", "signature", "start_line", "end_line", "docstring")


def _known(defined: DataFrame) -> DataFrame:
    return defined.groupBy("symbol").agg(F.max_by("symbol_id", F.struct("path", "line")).alias("symbol_id"))


def enriched(infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that the index adds: symbol_id, path, name, qualified_name, kind, signature, start_line, end_line,
    docstring."""
    return _added(defined(infos, occurrences, symbols))


def completed(infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Extracted symbols (with signature, docstring) with what they lack of these and the index knows."""
    known = defined(infos, occurrences, symbols).filter(~F.col("fresh")).groupBy("symbol_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("line", "symbol"))).alias(f"_{c}") for c in ("signature", "docstring")])
    return symbols.join(known, "symbol_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("signature", "docstring")}).select(*symbols.columns)


def definitions(infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, symbol_id: where each index symbol is defined, at last if several times."""
    return _known(defined(infos, occurrences, symbols))


def references(infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_id (innermost symbol around the occurrence, those that the index adds included, else its file),
    relation_type, target_id (null if the index does not define it), target_ref (the index symbol), line: one row for each
    different relation, those of a symbol to itself included."""
    uses = located(occurrences).filter(~F.col("defines")).select("path", "symbol", "line", "imports").withColumn("point_id", F.xxhash64("path", "symbol", "line"))
    every = cut(defined(infos, occurrences, symbols))  # read for the spans and for the targets
    spans = symbols.filter("kind <> 'file'").select("path", "symbol_id", "start_line", "end_line").unionByName(_added(every).select("path", "symbol_id", "start_line", "end_line"))
    whole = symbols.filter("kind = 'file'").select("path", F.col("symbol_id").alias("file_id"))
    at = innermost(uses.select("path", "line", "point_id").distinct(), spans, ["path"]).select("point_id", "symbol_id")
    placed = uses.join(at, "point_id").join(whole, "path", "left").withColumn("source_id", F.coalesce("symbol_id", "file_id")).drop("symbol_id")
    joined = placed.join(_known(every).withColumnRenamed("symbol_id", "target_id"), "symbol", "left")
    return joined.select("source_id", F.when(F.col("imports"), "imports").otherwise("references").alias("relation_type"), "target_id", F.col("symbol").alias("target_ref"), "line").distinct()


def related(relations: DataFrame, infos: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """relations (symbol, target, relations array<string>) between symbols: source_id, relation_type (implements,
    type_definition, related_reference, related_definition), target_id (null if the index does not define it),
    target_ref. Sources that the index does not define say nothing."""
    known = definitions(infos, occurrences, symbols)
    rows = relations.select("symbol", "target", F.explode("relations").alias("relation_type"))
    source = rows.join(known.withColumnRenamed("symbol_id", "source_id"), "symbol")
    target = known.select(F.col("symbol").alias("target"), F.col("symbol_id").alias("target_id"))
    return source.join(target, "target", "left").select("source_id", "relation_type", "target_id", F.col("target").alias("target_ref")).distinct()
