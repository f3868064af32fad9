"""Scoped lists over whole tables: documents with their chunks, symbols of a version, links with both roles, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import evaluation, integrity, listing
from quillmark.plans.recall import SCOPED
from quillmark.plans.registry import own, query, table

KNOWN = f"SELECT doc_id AS document_id, source AS workspace_id, CASE WHEN doc_id % 2 = 0 THEN 'rag' ELSE 'wiki' END AS source_type, scope_type, owner_user_id, owner_department_id, lang AS title, n_chars AS imported_at FROM ({SCOPED})"


@query(f"""SELECT document_id, title, (SELECT count(*) FROM conversations c WHERE c.conv_id = k.document_id AND c.role <> 'system') AS chunk_count FROM ({KNOWN}) k
WHERE workspace_id = 'src4' AND source_type = 'rag' AND (scope_type = 'workspace' OR (scope_type = 'personal' AND owner_user_id = 'u2') OR (scope_type = 'department' AND owner_department_id = 'd1'))""")
def knowledge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", "parent").otherwise("child").alias("chunk_level")
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), level)
    return listing.knowledge(own(spark, sf_dir, KNOWN), chunks, "src4", "u2", "d1", source_type="rag").select("document_id", "title", "chunk_count")


@query(f"SELECT document_id FROM ({KNOWN}) WHERE workspace_id = 'src2' AND scope_type = 'department' AND owner_department_id = 'd2'")
def knowledge_list_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.lit("child").alias("chunk_level"))
    return listing.knowledge(own(spark, sf_dir, KNOWN), chunks, "src2", "nobody", "d2", scope_type="department").select("document_id")


@query("SELECT DISTINCT source AS workspace_id, lang AS source_type, CAST(doc_id % 3 AS VARCHAR) AS source_path FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return listing.sources(docs.select(F.col("source").alias("workspace_id"), F.col("lang").alias("source_type"), (F.col("doc_id") % 3).cast("string").alias("source_path")))


# customers are projects with a current version, orders their files, line items symbols of a file in one of two versions
PROJECTS = "SELECT c_custkey AS project_id, 'v' || c_custkey % 2 AS current_commit FROM customer"
FILES = "SELECT o_orderkey AS file_id, o_orderpriority AS path FROM orders"
SYMBOLS = "SELECT l.l_orderkey * 10 + l.l_linenumber AS symbol_id, o.o_custkey AS project_id, 'v' || l.l_partkey % 2 AS commit_hash, l.l_orderkey AS file_id, l.l_returnflag || l.l_partkey AS name, l.l_returnflag || '.' || l.l_linestatus || l.l_suppkey AS qualified_name, l.l_linestatus AS symbol_kind, l.l_linenumber AS start_line FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return own(spark, sf_dir, PROJECTS), own(spark, sf_dir, SYMBOLS), own(spark, sf_dir, FILES)


def symbols_sql(project: int, query: str, commit: str, more: str, limit: int) -> str:
    return f"""SELECT s.symbol_id, s.name, s.qualified_name, f.path FROM ({PROJECTS}) p JOIN ({SYMBOLS}) s ON s.project_id = p.project_id AND s.commit_hash = {commit} JOIN ({FILES}) f ON f.file_id = s.file_id
 WHERE p.project_id = {project} AND (s.name ILIKE '%{query}%' OR s.qualified_name ILIKE '%{query}%' OR f.path ILIKE '%{query}%') {more} ORDER BY CASE WHEN lower(s.name) = lower('{query}') THEN 0 ELSE 1 END, f.path, s.start_line, length(s.qualified_name), s.symbol_id LIMIT {limit}"""


@query(symbols_sql(7, "r", "p.current_commit", "", 100))
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.symbols(*code(spark, sf_dir), 7, "r").select("symbol_id", "name", "qualified_name", "path")


@query(symbols_sql(8, "", "'v1'", "AND f.path = '5-LOW' AND s.symbol_kind = 'O'", 20))
def symbol_search_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.symbols(*code(spark, sf_dir), 8, file_path="5-LOW", kind="O", commit="v1", limit=20).select("symbol_id", "name", "qualified_name", "path")


RELATIONS = "SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_orderkey * 10 + l_linenumber AS source_symbol_id, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE ((l_partkey * 7) % 15000 + 1) * 10 + 1 END AS target_symbol_id, CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'imports' END AS relation_type, l_returnflag AS target_ref FROM lineitem"


@query(f"SELECT r.relation_id, r.relation_type, r.target_ref, ts.name AS target_name, tf.path AS target_path FROM ({RELATIONS}) r LEFT JOIN ({SYMBOLS}) ts ON ts.symbol_id = r.target_symbol_id LEFT JOIN ({FILES}) tf ON tf.file_id = ts.file_id")
def symbol_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, symbols, files = code(spark, sf_dir)
    return listing.outgoing(own(spark, sf_dir, RELATIONS), symbols, files).select("relation_id", "relation_type", "target_ref", "target_name", "target_path")


@query(f"SELECT r.relation_id, r.target_symbol_id, ss.name AS source_name, sf.path AS source_path, ss.start_line AS source_line FROM ({RELATIONS}) r JOIN ({SYMBOLS}) ss ON ss.symbol_id = r.source_symbol_id JOIN ({FILES}) sf ON sf.file_id = ss.file_id WHERE r.target_symbol_id IS NOT NULL")
def symbol_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, symbols, files = code(spark, sf_dir)
    return listing.incoming(own(spark, sf_dir, RELATIONS), symbols, files).select("relation_id", "target_symbol_id", "source_name", "source_path", "source_line")


FACTS = "SELECT p_partkey AS fact_id, p_brand AS fact_type, p_name AS name, p_type AS value, 'f' || p_size AS source_path, p_size AS source_line FROM part"
LINKS = "SELECT DISTINCT l_partkey AS source_fact_id, (l_partkey * 3) % 200 + 1 AS target_fact_id, 'r' || l_partkey % 4 AS relation_type FROM lineitem"


@query(f"SELECT l.relation_type, l.source_fact_id, l.target_fact_id, a.name AS source_name, a.fact_type AS source_fact_type, a.source_path AS source_path, b.name AS target_name, b.value AS target_value, b.source_line AS target_line FROM ({LINKS}) l JOIN ({FACTS}) a ON a.fact_id = l.source_fact_id JOIN ({FACTS}) b ON b.fact_id = l.target_fact_id")
def architecture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.links(own(spark, sf_dir, LINKS), own(spark, sf_dir, FACTS)).select("relation_type", "source_fact_id", "target_fact_id", "source_name", "source_fact_type", "source_path", "target_name", "target_value", "target_line")


@query(f"SELECT fact_id, fact_type, row_number() OVER (ORDER BY fact_type, name, source_path, source_line, fact_id) AS nth FROM ({FACTS}) ORDER BY nth LIMIT 30")
def ordered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = listing.facts(own(spark, sf_dir, FACTS)).limit(30)
    nth = F.row_number().over(Window.orderBy("fact_type", "name", "source_path", "source_line", "fact_id"))
    return first.select("fact_id", "fact_type", nth.cast("long").alias("nth"))


INVENTORY = "SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN '.yaml' WHEN 1 THEN '.yml' WHEN 2 THEN '.py' ELSE '.txt' END AS path, p_type AS role, CASE p_size % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' ELSE 'unclassified' END AS parser_status FROM part"
YAML = "(contains(lower(concat_ws(' ', p_partkey, path, role, parser_status)), 'yaml') OR contains(lower(concat_ws(' ', p_partkey, path, role, parser_status)), 'yml'))"


@query(f"SELECT p_partkey, path FROM ({INVENTORY}) WHERE {YAML} ORDER BY path, p_partkey LIMIT 50 OFFSET 10")
def inventory_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.inventory(own(spark, sf_dir, INVENTORY), "YAML", 50, 10, ("path", "p_partkey"))[0].select("p_partkey", "path")


@query(f"SELECT count(*) FILTER ({YAML}) AS matches, 10 AS \"offset\", 50 AS \"limit\", count(*) FILTER ({YAML}) > 60 AS has_more, count(*) AS total, count(*) FILTER (parser_status = 'parsed') AS parsed, count(*) FILTER (parser_status = 'partial') AS partial, count(*) FILTER (parser_status = 'unsupported') AS unsupported, count(*) FILTER (parser_status = 'unclassified') AS unclassified FROM ({INVENTORY})")
def inventory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.inventory(own(spark, sf_dir, INVENTORY), "YAML", 50, 10, ("path", "p_partkey"))[1]


REGISTERED = "SELECT c_custkey AS project_id, CAST(c_nationkey AS VARCHAR) AS workspace_id, c_mktsegment AS repository_key FROM customer"


@query(f"SELECT n.workspace_id, n.repository_key, (SELECT min(project_id) FROM ({REGISTERED}) r WHERE r.workspace_id = n.workspace_id AND r.repository_key = n.repository_key) AS project_id FROM (SELECT DISTINCT CAST(s_suppkey % 30 AS VARCHAR) AS workspace_id, 'BUILDING' AS repository_key FROM supplier) n")
def registered_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.of_repository(own(spark, sf_dir, REGISTERED.replace("VARCHAR", "STRING")), own(spark, sf_dir, "SELECT DISTINCT CAST(s_suppkey % 30 AS STRING) AS workspace_id, 'BUILDING' AS repository_key FROM supplier"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR trim(p_brand) = '' THEN 'project:' || p_partkey ELSE 'repository:' || lower(trim(p_brand)) END AS resource FROM part")
def lock_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", listing.lock_resource(key, F.col("p_partkey")).alias("resource"))


@query("SELECT c.c_custkey AS project_id, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS file_count, (SELECT count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_custkey = c.c_custkey) AS symbol_count FROM customer c")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, symbols, _ = code(spark, sf_dir)
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"))
    return listing.scan_totals(projects.select("project_id"), "project_id", file=files, symbol=symbols.select("project_id"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'succeeded' WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY o_custkey")
def module_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"))
    return listing.tally(rows, "o_custkey")


PARENTED = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id - doc_id % 4 END AS parent_chunk_id, CASE WHEN doc_id % 35 = 0 THEN -1 ELSE doc_id - doc_id % 4 END AS document_id, source AS workspace_id FROM documents"


@query(f"SELECT c.chunk_id FROM ({PARENTED}) c JOIN ({PARENTED}) p ON p.chunk_id = c.parent_chunk_id WHERE c.document_id IS DISTINCT FROM p.document_id OR c.workspace_id IS DISTINCT FROM p.workspace_id")
def parent_scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.apart(own(spark, sf_dir, PARENTED), "chunk_id", "parent_chunk_id", ["document_id", "workspace_id"]).select("chunk_id")


OWNED = "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS owner_user_id, CASE WHEN c_custkey % 14 = 0 THEN '' ELSE c_mktsegment END AS created_by_user_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey * 2 END AS current_snapshot FROM customer"


@query(f"SELECT project_id FROM ({OWNED}) WHERE owner_user_id IS NULL OR created_by_user_id IS NULL OR created_by_user_id = ''")
def ownerless_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.missing_values(own(spark, sf_dir, OWNED), ["owner_user_id", "created_by_user_id"]).select("project_id")


@query(f"SELECT p.project_id FROM ({OWNED}) p LEFT JOIN (SELECT o_orderkey AS snapshot_id, o_custkey AS project_id FROM orders) s ON s.snapshot_id = p.current_snapshot WHERE s.snapshot_id IS NULL OR s.project_id IS DISTINCT FROM p.project_id")
def snapshot_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("project_id"))
    return integrity.bad_pointers(own(spark, sf_dir, OWNED), "current_snapshot", snapshots, "snapshot_id", "project_id").select("project_id")


@query("SELECT o_custkey, o_orderkey, 'missing' AS fault FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 EXCEPT SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL SELECT o_custkey, o_orderkey, 'extra' FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 EXCEPT SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def catalogue_equals_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return integrity.differences(rows.filter("o_orderkey % 5 <> 0"), rows.filter("o_orderkey % 7 <> 0"), ["o_custkey", "o_orderkey"])


@query("SELECT 'documents' AS tab, 'lang' AS col, 'wrong type' AS fault UNION ALL SELECT 'documents', 'vector', 'missing' UNION ALL SELECT 'nowhere', NULL, 'missing'")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("documents", "labels")}
    return integrity.readiness(spark, tables, {"documents": {"doc_id": "bigint", "lang": "int", "vector": "array<float>"}, "labels": {"doc_id": "bigint"}, "nowhere": {"x": "int"}})


@query("SELECT doc_id, regexp_matches('ws-' || doc_id, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AND doc_id % 3 <> 0 AS workspace_ok, regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS uuid_ok FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(printf('%08x-0000-4000-8000-%012x', doc_id, doc_id)) ELSE 'x' || doc_id END AS u FROM documents)")
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.functions import text as T

    doc = F.col("doc_id")
    name = F.concat(F.when(doc % 3 == 0, " /ws-").otherwise(" ws-"), doc.cast("string"))
    uuid = F.when(doc % 2 == 0, F.concat(F.lpad(F.lower(F.hex(doc)), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.lower(F.hex(doc)), 12, "0"))).otherwise(F.concat(F.lit("x"), doc.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", T.workspace_id(name).isNotNull().alias("workspace_ok"), T.is_uuid(uuid).alias("uuid_ok"))


SHOWN = "SELECT conv_id AS case_id, turn + 1 AS rank, text AS source_text, CASE WHEN role = 'assistant' THEN 'parent' ELSE 'child' END AS context_level, length(text) AS context_tokens FROM conversations"
FOUND = "max(CAST(contains(lower(source_text), '{}') AS INTEGER))"


@query(f"""SELECT case_id, round(({FOUND.format('la ')} + {FOUND.format('the ')} + {FOUND.format('und ')}) / 3.0::DOUBLE, 6) AS recall, round(coalesce(({FOUND.format('la ')} FILTER (context_level = 'parent') + {FOUND.format('the ')} FILTER (context_level = 'parent') + {FOUND.format('und ')} FILTER (context_level = 'parent')) / 3.0::DOUBLE, 0), 6) AS parent_recall FROM ({SHOWN}) GROUP BY case_id""")
def source_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = own(spark, sf_dir, SHOWN)
    cases = contexts.select("case_id").distinct().withColumn("terms", F.array(F.lit("la "), F.lit("The "), F.lit("und ")))
    both = evaluation.source_recall(contexts, cases), evaluation.source_recall(contexts, cases, True).withColumnRenamed("recall", "parent_recall")
    return both[0].join(both[1], "case_id")


@query(f"""WITH c AS ({SHOWN}), h AS (SELECT case_id, rank, contains(lower(source_text), 'la ') AS hit FROM c WHERE rank <= 5),
m AS (SELECT case_id, round(count(*) FILTER (hit) / 5.0::DOUBLE, 6) AS precision_at_k, count(*) FILTER (hit) > 0 AS source_hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank FROM h GROUP BY case_id),
t AS (SELECT case_id, count(*) FILTER (context_level = 'parent') AS parent_context_count, CAST(sum(context_tokens) AS BIGINT) AS context_tokens, (max(contains(lower(source_text), 'und ')::INT) + max(contains(lower(source_text), 'zzz')::INT)) / 2.0::DOUBLE AS cov, max(contains(lower(source_text), 'la ')::INT)::DOUBLE AS context_recall, coalesce(max(contains(lower(source_text), 'la ')::INT) FILTER (context_level = 'parent'), 0)::DOUBLE AS parent_context_recall FROM c GROUP BY case_id)
SELECT t.case_id, 'hybrid' AS route, t.case_id % 2 = 0 AS route_correct, true AS source_available, coalesce(m.source_hit, false) AS source_hit, coalesce(m.precision_at_k, 0) AS precision_at_k, coalesce(m.reciprocal_rank, 0) AS reciprocal_rank, round(t.cov, 6) AS required_term_coverage, t.context_recall, t.parent_context_recall, t.parent_context_count, t.context_tokens FROM t LEFT JOIN m USING (case_id)""")
def case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = own(spark, sf_dir, SHOWN)
    one = lambda *words: F.array(*map(F.lit, words))
    cases = contexts.select("case_id").distinct().select("case_id", F.lit("hello").alias("question"), F.when(F.col("case_id") % 2 == 0, "hybrid").otherwise("rag").alias("expected_route"), one("La ").alias("source_terms"), one("und ", "zzz").alias("required_terms"))
    available = spark.range(1).select(F.lit("la carte").alias("source_name"))
    return evaluation.case_report(cases, contexts, contexts, available, 5).drop("ndcg")
