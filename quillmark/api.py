"""The knowledge base as functions over tables: ingest, search, expand, scan, trace.

Tables live on any file system Spark reads; `versions.Tables` commits several of them at once, so that readers never see
half a write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import architecture, catalog, chunking, facts, providers, retrieval, upserts, yamls
from quillmark.session import cut
from quillmark.sources import files


@dataclass(frozen=True)
class Scope:
    """Who asks: a workspace, and the user and department whose rows it may also show."""

    workspace_id: str
    user_id: str | None = None
    department_id: str | None = None


def chunked(documents: DataFrame, embedder: providers.Embedder = providers.hashed_vectors) -> DataFrame:
    """documents (document_id long, workspace_id, source_type, text): parent and child chunks, children with vectors."""
    pieces = chunking.parent_child(documents.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document_id")
    parent = F.xxhash64("document_id", "parent_index", F.lit(-1))
    is_child = F.col("chunk_level") == "child"
    own = pieces.select("document_id", "chunk_level", "parent_index", "child_index", "content", "char_count", F.when(is_child, F.xxhash64("document_id", "parent_index", "child_index")).otherwise(parent).alias("chunk_id"), F.when(is_child, parent).alias("parent_chunk_id"))
    vectors = own.filter(is_child).withColumn("embedding", providers.embedded(F.col("content"), embedder))
    parents = own.filter(~is_child).withColumn("embedding", F.lit(None).cast("array<float>"))
    return vectors.unionByName(parents).join(documents.select("document_id", "workspace_id", "source_type"), "document_id")


def ingest(existing: DataFrame, incoming: DataFrame, embedder: providers.Embedder = providers.hashed_vectors, order: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classify incoming against existing documents and the rows before it in the batch, and chunk only what each new or
    revised document is in the end, before any vector is made.

    incoming has text and the columns of upserts.classify. Returns (classified, chunks, revisions); the chunks take the
    place of all that those documents had."""
    found = upserts.classify(existing, incoming, order)
    fresh = upserts.latest(found).withColumn("document_id", F.col("target_id"))
    return found, chunked(fresh, embedder), upserts.revisions(found)


def eligible(chunks: DataFrame, documents: DataFrame, scope: Scope, source_types: list[str]) -> DataFrame:
    """Child chunks with vectors of active documents that the scope may see."""
    seen = documents.filter((F.col("status") == "active") & (F.col("workspace_id") == scope.workspace_id) & retrieval.visible(scope.user_id, scope.department_id))
    mine = chunks.filter((F.col("workspace_id") == scope.workspace_id) & F.col("source_type").isin(source_types) & (F.col("chunk_level") == "child") & F.col("embedding").isNotNull())
    return mine.join(seen.select("document_id", "workspace_id"), ["document_id", "workspace_id"], "left_semi")


def search(chunks: DataFrame, documents: DataFrame, scope: Scope, vector: list[float], question: str, source_types: list[str], limit: int = 20) -> DataFrame:
    """Vector and keyword recall under the scope, fused, at most three of a document: query_id, rank, chunk_id,
    parent_chunk_id, document_id, content, fused_score. Text joins the few that are left."""
    own = eligible(chunks, documents, scope, source_types)
    terms = chunks.sparkSession.range(1).select(T.keyword_terms(F.lit(question))).first()[0]
    first = lambda df, score: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")))  # noqa: E731  over `limit` rows
    by_vector = first(retrieval.nearest(own.select("chunk_id", "embedding"), vector, limit, "chunk_id"), "score")
    by_words = first(retrieval.keyword_recall(own.select("chunk_id", "content"), terms, limit, "chunk_id"), "keyword_score")
    fused = retrieval.fuse([by_vector, by_words], "chunk_id").join(own.select("chunk_id", "document_id"), "chunk_id")
    best = retrieval.diversify(fused, "document_id", "chunk_id", limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "chunk_id"))).withColumn("query_id", F.lit(0))
    return ranked.join(chunks.select("chunk_id", "parent_chunk_id", "content"), "chunk_id")


def context(hits: DataFrame, chunks: DataFrame, question: str, budget: int = 6000, top: int = 8) -> DataFrame:
    """The best hits after reranking, as parent context under the token budget."""
    best = providers.reranked(hits, question, top).drop("rank").withColumnRenamed("new_rank", "rank")
    return retrieval.expand(best, chunks.filter("chunk_level = 'parent'").select("chunk_id", "content"), budget)


def scan(spark: SparkSession, root: str, project_id: str) -> dict[str, DataFrame]:
    """A project's files, symbols, relations, configuration, architecture facts and links, with its content version."""
    tree = files.tree(spark, root)
    inventory = files.inventory(tree)
    version = catalog.fingerprint(inventory.withColumn("project_id", F.lit(project_id)), "project_id").select("project_id", F.col("version").alias("commit_hash"))
    source = files.sources(tree)
    found = cut(facts.extract(source.select("path", "content")))  # both are read several times below
    everything = tree.filter(files.looked_into(F.col("path"))).select("path", files.text_of(F.col("content")).alias("content"))
    arch = cut(architecture.extract(everything)).withColumn("fact_id", F.xxhash64("fact_type", "name", "value", "path", "line"))
    symbols = facts.symbols(found).withColumn("symbol_id", F.xxhash64("path", "qualified_name", "start_line"))
    spans = symbols.filter("kind <> 'file'").select("path", "symbol_id", "start_line", "end_line")
    attached = facts.innermost(arch.withColumn("point_id", F.col("fact_id")), spans, ["path"])
    tables = {"files": inventory, "symbols": symbols, "relations": facts.relations(found), "config": yamls.config_facts(files.config_files(tree)).orderBy("path", "line", "key_path", "fact_type", "value").limit(files.MOST_FACTS), "facts": attached, "links": facts.links(arch)}
    return {n: df.join(F.broadcast(version)) for n, df in tables.items()} | {"version": version}
