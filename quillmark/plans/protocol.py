"""Queries over what passes between loops, tools and callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import protocol
from quillmark.plans.registry import own, query, table

STATUSES = "SELECT o_orderkey, CAST(400 + o_orderkey % 120 AS INTEGER) AS status FROM orders"
CODES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in protocol.ERROR_CODES.items())


@query(f"SELECT o_orderkey, status, CASE status {CODES} ELSE 'HTTP_ERROR' END AS code, status IN (429, 502, 503, 504) AS retryable FROM ({STATUSES})")
def error_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, STATUSES).select("o_orderkey", "status", protocol.error_code(F.col("status")).alias("code"), protocol.retryable(F.col("status")).alias("retryable"))


SAID = """SELECT conv_id * 1000 + turn AS case_id, CASE turn % 3 WHEN 0 THEN '{"next_action": "retrieve_rag", "route": "rag", "queries": [" c' || conv_id || ' ", "", "' || role || '"], "reason": "r' || turn || '"}'
 WHEN 1 THEN '{"next_action": "fly' || conv_id || '"}' ELSE '{"next_action": "answer", "claims": [{"text": "' || role || '", "evidence_ids": ["E1"]}]}' END AS answer FROM conversations"""


@query("""SELECT conv_id * 1000 + turn AS case_id, CASE turn % 3 WHEN 0 THEN 'retrieve_rag' WHEN 1 THEN 'fly' || conv_id ELSE 'answer' END AS next_action, CASE WHEN turn % 3 = 0 THEN 'rag' END AS route, CASE WHEN turn % 3 = 0 THEN 'c' || conv_id || '|' || role ELSE '' END AS queries,
 CASE WHEN turn % 3 = 0 THEN 'r' || turn ELSE '' END AS reason, CASE WHEN turn % 3 = 1 THEN 'unsupported_action' END AS problem FROM conversations""")
def decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.decisions(own(spark, sf_dir, SAID), ["retrieve_rag", "query_code_wiki", "answer", "refuse"], ["rag", "wiki", "hybrid"])
    return found.select("case_id", "next_action", "route", F.array_join("queries", "|").alias("queries"), "reason", "problem")


EVIDENCE = "SELECT doc_id % 9 AS loop_id, doc_id AS evidence_id, CASE WHEN doc_id % 2 = 0 THEN 'code_wiki' ELSE 'rag' END AS source_type, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS project_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS commit_id, 'src1' AS anchor_project, 'en' AS anchor_commit FROM documents"


@query(f"""SELECT loop_id, evidence_id, reason FROM (SELECT *, CASE WHEN source_type = 'code_wiki' AND (project_id IS NULL OR commit_id IS NULL) THEN 'scope_required' WHEN project_id IS NOT NULL AND project_id NOT IN ('src1', 'src2', 'src3') THEN 'project_mismatch'
 WHEN project_id = anchor_project AND commit_id <> anchor_commit THEN 'commit_mismatch' END AS reason FROM ({EVIDENCE})) WHERE reason IS NOT NULL""")
def scope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    unless = lambda n, c: F.when(F.col("doc_id") % n != 0, F.col(c))
    rows = docs.select((F.col("doc_id") % 9).alias("loop_id"), F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 2 == 0, "code_wiki").otherwise("rag").alias("source_type"), unless(5, "source").alias("project_id"), unless(7, "lang").alias("commit_id"), F.lit("src1").alias("anchor_project"), F.lit("en").alias("anchor_commit"))
    allowed = spark.range(9).select(F.col("id").alias("loop_id"), F.explode(F.array(F.lit("src2"), F.lit("src3"))).alias("project_id"))
    return protocol.scope_violations(rows, allowed).select("loop_id", "evidence_id", "reason")


@query("""WITH m AS (SELECT source AS transcript_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, CASE WHEN doc_id % 3 = 0 THEN 'tool' ELSE 'user' END AS role, CAST(n_chars AS BIGINT) AS chars FROM documents),
c AS (SELECT *, least(chars, CASE WHEN role = 'tool' THEN 5000 ELSE 8000 END) AS kept_chars FROM m), s AS (SELECT *, sum(kept_chars) OVER (PARTITION BY transcript_id) AS total, max(nth) OVER (PARTITION BY transcript_id) AS n FROM c)
SELECT transcript_id, nth, kept_chars FROM s WHERE total <= 70000 OR nth <= 2 OR nth > n - 12""")
def transcript_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("transcript_id"), nth.alias("nth"), F.when(F.col("doc_id") % 3 == 0, "tool").otherwise("user").alias("role"), F.col("n_chars").alias("chars"))
    return protocol.compacted(rows).select("transcript_id", "nth", F.col("kept_chars").cast("long").alias("kept_chars"))


@query("""WITH RECURSIVE o AS (SELECT event_id, event_type, ts, event_id % 50 = 0 AS forced, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT event_id, event_type, r, ts AS last, true AS checked FROM o WHERE r = 1 UNION ALL SELECT o.event_id, o.event_type, o.r, CASE WHEN o.forced OR o.ts - w.last >= INTERVAL 30 MINUTE THEN o.ts ELSE w.last END, o.forced OR o.ts - w.last >= INTERVAL 30 MINUTE FROM w JOIN o ON o.event_type = w.event_type AND o.r = w.r + 1)
SELECT event_type, count(*) AS uses, count(*) FILTER (checked) AS checks FROM w GROUP BY event_type""")
def lease_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("event_id") % 50 == 0).alias("forced"))
    return protocol.lease_checks(rows, "event_type", "ts", 1800.0).groupBy("event_type").agg(F.count("*").alias("uses"), F.count_if("checked").alias("checks"))


@query("SELECT conv_id, string_agg('[' || (turn + 1) || '] 类型=' || role || ' 来源=' || 'c' || conv_id || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS evidence FROM conversations GROUP BY conv_id")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), F.col("role").alias("source_type"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_ref"), F.col("text").alias("content"))
    return protocol.evidence_text(rows, "conv_id")


@query("SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS summary FROM conversations WHERE role = 'user'")
def question_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", protocol.question_summary(F.col("text")).alias("summary"))


@query("""WITH s AS (SELECT p_partkey, p_name, substr(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 48) AS slug FROM part) SELECT p_partkey, CASE WHEN slug = '' THEN 'project' ELSE slug END || '-' || substr(sha256(p_name), 1, 8) AS folder FROM s""")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", protocol.folder_name(F.col("p_name")).alias("folder"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 1")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter(F.col("k") % 3 == 1)


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'de')")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    ids = docs.select("doc_id")
    return count(labels.intersect(docs.filter("lang = 'en'").select("doc_id")), "both").union(count(ids.subtract(labels), "missing")).union(count(labels.union(docs.filter("lang = 'de'").select("doc_id")).distinct(), "either"))


@query("SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM lineitem) AS symbols, (SELECT count(*) FROM part) AS relations, (SELECT max(o_orderdate) FROM orders) AS latest")
def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, n: table(spark, sf_dir, t).agg(F.lit(n).alias("what"), F.count("*").alias("n"), (F.max("o_orderdate") if t == "orders" else F.lit(None).cast("timestamp_ntz")).alias("at"))
    rows = count("orders", "files").union(count("lineitem", "symbols")).union(count("part", "relations"))
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in ("files", "symbols", "relations")], F.max("at").alias("latest"))
