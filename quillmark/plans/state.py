"""Knowledge loops over whole tables: events are calls and decisions of loops, documents evidence, conversations answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import agent
from quillmark.plans.registry import query, table
from quillmark.plans.spaces import own

# a loop is a user's day; its calls are few
LOOPS = "SELECT user_id * 100 + day(ts) AS loop_id, event_id AS seq, event_type, CAST(event_id % 4 AS INTEGER) AS k, user_id FROM events"
CALLS = f"SELECT loop_id, seq, event_type AS action, event_type || ':' || k AS signature, k = 3 AS requires_project, CASE WHEN user_id % 2 = 0 THEN 'p' END AS project_id FROM ({LOOPS})"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY loop_id ORDER BY seq) AS r FROM ({CALLS})),
w AS (SELECT loop_id, 0::BIGINT AS r, 0::BIGINT AS seq, 0 AS n, CAST([] AS VARCHAR[]) AS seen, false AS closed, false AS admitted, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT loop_id FROM o)
 UNION ALL SELECT loop_id, r, seq, n + (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN list_append(seen, signature) ELSE seen END, closed OR coalesce(reason IN ('max_tool_calls_exceeded', 'project_scope_required'), false), reason IS NULL, reason FROM (
  SELECT o.loop_id, o.r, o.seq, o.signature, w.n, w.seen, w.closed, CASE WHEN w.closed THEN 'closed' WHEN w.n >= 3 THEN 'max_tool_calls_exceeded' WHEN o.requires_project AND o.project_id IS NULL THEN 'project_scope_required' WHEN list_contains(w.seen, o.signature) THEN 'duplicate' END AS reason FROM w JOIN o ON o.loop_id = w.loop_id AND o.r = w.r + 1))
SELECT loop_id, seq, admitted, reason FROM w WHERE r > 0""")
def action_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.admitted_actions(own(spark, sf_dir, CALLS), 3)


@query(f"SELECT loop_id, split_part(signature, ':', 1) AS action, count(DISTINCT signature) AS attempts FROM ({CALLS}) GROUP BY 1, 2")
def action_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.attempts(own(spark, sf_dir, CALLS))


REPORTS = "SELECT conv_id AS loop_id, CAST(length(text) % 5 AS INTEGER) - 1 AS tool_calls, CAST(turn % 3 AS INTEGER) AS rounds, 4 AS used_tool_calls, 2 AS used_rounds FROM conversations"


@query(f"SELECT *, CASE WHEN used_tool_calls > 8 THEN 'max_tool_calls_exceeded' WHEN used_rounds > 6 THEN 'max_rounds_exceeded' END AS stop_reason FROM (SELECT loop_id, CAST(4 + sum(greatest(0, tool_calls)) AS BIGINT) AS used_tool_calls, CAST(2 + sum(greatest(0, rounds)) AS BIGINT) AS used_rounds FROM ({REPORTS}) GROUP BY loop_id)")
def child_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.child_budgets(own(spark, sf_dir, REPORTS), 8, 6)


SUGGESTED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'strict_project' WHEN 1 THEN 'candidate_projects' WHEN 2 THEN 'soft_project' END AS suggested, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS project_id, CASE doc_id % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'allow_authorized' ELSE 'candidate_set' END AS policy FROM documents"


@query(f"""SELECT doc_id, CASE WHEN suggested = 'strict_project' AND project_id IS NOT NULL THEN 'strict_project' WHEN suggested = 'candidate_projects' THEN suggested ELSE 'soft_project' END AS scope_mode,
 CASE WHEN suggested = 'strict_project' AND project_id IS NOT NULL THEN 'none' WHEN suggested = 'candidate_projects' THEN CASE WHEN policy <> 'deny' THEN 'cross_project_required' ELSE 'user_confirmation_required' END WHEN project_id IS NOT NULL THEN 'rag_allowed' ELSE 'none' END AS expansion_required,
 coalesce(policy <> 'deny' AND project_id IN ('src1', 'src2'), false) AS may_expand FROM ({SUGGESTED})""")
def scope_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = agent.narrowed_scope(F.col("suggested"), F.col("project_id"), F.col("policy"))
    may = agent.may_expand(F.col("policy"), F.array(F.lit("src1"), F.lit("src2")), F.col("project_id"))
    return own(spark, sf_dir, SUGGESTED).select("doc_id", scope["scope_mode"].alias("scope_mode"), scope["expansion_required"].alias("expansion_required"), F.coalesce(may, F.lit(False)).alias("may_expand"))


DECISIONS = f"SELECT loop_id, seq, CASE CAST(seq % 5 AS INTEGER) WHEN 0 THEN 'answer' WHEN 1 THEN 'refuse' WHEN 2 THEN 'replan' WHEN 3 THEN 'retrieve_rag' ELSE 'query_code_wiki' END AS next_action, CASE WHEN k = 1 THEN event_type END AS route, CASE WHEN k = 2 THEN 'i' || seq % 10 END AS intent, CASE WHEN k = 0 THEN '' ELSE 'because' END AS reason FROM ({LOOPS})"


@query(f"""WITH d AS ({DECISIONS}), l AS (SELECT loop_id, arg_max(next_action, seq) AS next_action, arg_max(reason, seq) AS reason, max(seq) FILTER (route IS NOT NULL) AS ro, max(seq) FILTER (intent IS NOT NULL OR route IS NOT NULL) AS io, max(seq) FILTER (next_action = 'answer') AS ao, count(*) AS decision_count FROM d GROUP BY loop_id)
SELECT l.loop_id, l.next_action, l.next_action = 'answer' AS answer_ready, l.next_action = 'refuse' AS refused, CASE l.next_action WHEN 'answer' THEN 'finish' WHEN 'refuse' THEN 'refuse' WHEN 'replan' THEN 'replan' ELSE 'execute' END AS phase,
 CASE l.next_action WHEN 'answer' THEN 'evidence_sufficient' WHEN 'refuse' THEN CASE WHEN l.reason <> '' THEN l.reason ELSE 'evidence_insufficient' END END AS stop_reason, r.route, coalesce(i.intent, i.route) AS intent, CAST(l.ao AS BIGINT) AS approved, l.decision_count
FROM l LEFT JOIN d r ON r.loop_id = l.loop_id AND r.seq = l.ro LEFT JOIN d i ON i.loop_id = l.loop_id AND i.seq = l.io""")
def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agent.decided(own(spark, sf_dir, DECISIONS).withColumn("claims", F.array("seq")))
    return rows.withColumn("approved", F.get("claims", F.lit(0))).drop("claims")


@query(f"""WITH s AS (SELECT loop_id, arg_max(seq % 5, seq) AS a, count(*) AS n FROM ({LOOPS}) GROUP BY loop_id)
SELECT loop_id, CASE WHEN n % 3 = 0 THEN false WHEN n % 2 = 0 THEN true ELSE a = 0 END AS answer_ready, CASE WHEN n % 3 = 0 THEN true WHEN n % 2 = 0 THEN false ELSE a = 1 END AS refused, CASE WHEN n % 3 = 0 THEN 'budget' WHEN n % 2 = 0 OR a = 0 THEN 'evidence_sufficient' WHEN a = 1 THEN 'evidence_insufficient' END AS stop_reason FROM s""")
def loop_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("decision_count")
    state = agent.decided(own(spark, sf_dir, DECISIONS).withColumns({"claims": F.array("seq"), "reason": F.lit("")}))
    return agent.closed(state, n % 2 == 0, F.when(n % 3 == 0, "budget")).select("loop_id", "answer_ready", "refused", "stop_reason")


MODES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'rag' WHEN 2 THEN 'codewiki' ELSE 'hybrid' END AS mode, doc_id % 3 = 0 AS strict, doc_id % 5 <> 0 AS has_project, CAST(doc_id % 7 AS INTEGER) AS calls_left, CAST(doc_id % 3 AS INTEGER) AS rag, CAST(doc_id % 2 * 2 AS INTEGER) AS wiki, doc_id % 6 < 3 AS has_evidence FROM documents"


@query(f"""WITH p AS (SELECT *, calls_left > 0 AND mode IN ('auto', 'rag', 'hybrid') AND NOT strict AND rag < 2 AS r, calls_left > 0 AND mode <> 'rag' AND has_project AND wiki < 2 AS w FROM ({MODES}))
SELECT doc_id, concat_ws(',', CASE WHEN has_evidence THEN 'answer' END, CASE WHEN w THEN 'query_code_wiki' END, CASE WHEN NOT (r OR w) THEN 'refuse' END, CASE WHEN r OR w THEN 'replan' END, CASE WHEN r THEN 'retrieve_rag' END) AS possible, CASE WHEN w AND has_project THEN 'query_code_wiki' WHEN r THEN 'retrieve_rag' ELSE 'refuse' END AS fallback FROM p""")
def possible_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.create_map(F.lit("retrieve_rag"), F.col("rag"), F.lit("query_code_wiki"), F.col("wiki"))
    could = agent.possible_actions(F.col("mode"), F.col("strict"), F.col("has_project"), F.col("calls_left"), tried, F.col("has_evidence"))
    rows = own(spark, sf_dir, MODES).withColumn("p", could)
    return rows.select("doc_id", F.array_join("p", ",").alias("possible"), agent.fallback_action(F.col("p"), F.when(F.col("has_project"), "x")).alias("fallback"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'retrieve_rag,query_code_wiki' WHEN 1 THEN 'query_code_wiki' ELSE '' END ELSE CASE doc_id % 3 WHEN 0 THEN 'retrieve_rag,query_code_wiki' ELSE '' END END AS missing FROM documents")
def mode_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, both = F.col("doc_id"), F.array(F.lit("retrieve_rag"), F.lit("query_code_wiki"))
    succeeded = F.when(doc % 3 == 0, F.slice(both, 1, 0)).when(doc % 3 == 1, F.slice(both, 1, 1)).otherwise(both)
    missing = agent.missing_capabilities(F.when(doc % 2 == 0, "hybrid").otherwise("auto"), succeeded)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"))


ROUNDS = "SELECT conv_id AS loop_id, CAST(turn AS INTEGER) AS round, CASE WHEN length(text) % 4 = 0 THEN 0 ELSE CAST(length(text) % 3 AS INTEGER) + 1 END AS executed, CASE WHEN length(text) % 12 = 0 THEN 'duplicate' END AS blocked, length(text) % 2 = 1 AS progress FROM conversations"


@query(f"""WITH a AS (SELECT *, sum(executed) OVER w AS tool_calls, sum((executed > 0 AND progress)::INT) OVER w AS moves FROM ({ROUNDS}) WINDOW w AS (PARTITION BY loop_id ORDER BY round)),
b AS (SELECT *, sum((executed > 0 AND NOT progress)::INT) OVER (PARTITION BY loop_id, moves ORDER BY round) AS unchanged FROM a),
c AS (SELECT *, CASE WHEN blocked IS NOT NULL AND executed = 0 THEN blocked WHEN unchanged >= 2 THEN 'no_new_evidence' WHEN tool_calls >= 9 THEN 'tool_budget_exhausted' WHEN round + 1 >= 7 THEN 'round_budget_exhausted' END AS now FROM b)
SELECT c.loop_id, c.round, CAST(c.tool_calls AS BIGINT) AS tool_calls, CAST(c.unchanged AS BIGINT) AS unchanged, (SELECT arg_min(x.now, x.round) FROM c x WHERE x.loop_id = c.loop_id AND x.round <= c.round AND x.now IS NOT NULL) AS stop_reason FROM c""")
def round_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.stopped(own(spark, sf_dir, ROUNDS), 9, 7).select("loop_id", "round", "tool_calls", "unchanged", "stop_reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 4 + doc_id % 3 + (doc_id % 5 = 0)::INT > 0 THEN doc_id % 4 + doc_id % 3 + (doc_id % 5 = 0)::INT WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS n FROM documents""")
def usable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    some = lambda n: F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), (doc % n).cast("int")), lambda i: i.cast("string"))
    result = F.to_json(F.struct(F.when(doc % 7 == 0, "failed").alias("error"), some(4).alias("items"), some(3).alias("edges"), F.when(doc % 5 == 0, "text").alias("source"), (doc % 2).alias("count")))
    return table(spark, sf_dir, "documents").select("doc_id", agent.usable_evidence(result).alias("n"))


CLAIMS = "SELECT conv_id AS case_id, turn AS ordinal, role || ' says ' || length(text) AS text, turn % 3 AS n FROM conversations"


@query(f"SELECT case_id, string_agg(rtrim('- ' || text || ' ' || CASE n WHEN 0 THEN '' WHEN 1 THEN '[E0]' ELSE '[E0] [E1]' END), chr(10) ORDER BY ordinal) AS answer FROM ({CLAIMS}) GROUP BY case_id")
def claim_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.lit("E"), i.cast("string")))
    return agent.rendered_claims(own(spark, sf_dir, CLAIMS).withColumn("evidence_ids", ids))


@query("SELECT doc_id AS loop_id, source AS project_id, n_chars AS used_rounds, doc_id % 4 AS evidence_count, 'finish' AS phase FROM documents")
def public_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("loop_id"), F.col("source").alias("project_id"), F.col("text").alias("question"), F.col("n_chars").alias("used_rounds"), F.slice(F.array(*map(F.lit, range(4))), F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("evidence"), F.lit("finish").alias("phase"))
    return agent.public(state).withColumn("evidence_count", F.col("evidence_count").cast("long"))


@query("SELECT c.conv_id AS answer_id, c.turn AS citation, d.source, d.n_chars FROM conversations c LEFT JOIN documents d ON d.doc_id % 97 = c.conv_id AND d.doc_id // 97 = c.turn")
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("citation"))
    evidence = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("answer_id"), F.floor(F.col("doc_id") / 97).alias("evidence_id"), "source", "n_chars")
    return agent.cited_evidence(citations, evidence)


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'RAG 文档' ELSE 'n' || label END AS source_name, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'r' END AS source_ref, round(coalesce(CASE WHEN vec_id % 2 = 0 THEN vec_id / 7.0::DOUBLE END, 0), 4) AS similarity, round(vec_id / 13.0::DOUBLE, 6) AS rerank_score, round(vec_id / 17.0::DOUBLE, 6) AS score FROM embeddings")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    hits = table(spark, sf_dir, "embeddings").select(v.alias("chunk_id"), F.when(v % 3 != 0, F.concat(F.lit("n"), F.col("label").cast("string"))).alias("source_name"), F.when(v % 5 != 0, "r").alias("source_ref"), F.when(v % 2 == 0, v / 7.0).alias("similarity"), (v / 13.0).alias("rerank_score"), (v / 17.0).alias("score"))
    return agent.source_rows(hits)


@query("""WITH s AS (SELECT l_orderkey % 100 AS answer_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS symbol_id, l_returnflag AS path, l_linenumber AS start_line, l_linestatus AS qualified_name FROM lineitem),
a AS (SELECT answer_id, path, start_line, qualified_name, min(symbol_id) AS first FROM s GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first) AS citation FROM a)
SELECT s.answer_id, s.symbol_id, '[C' || f.citation || ']' AS citation FROM s JOIN f USING (answer_id, path, start_line, qualified_name)""")
def compact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators import controller

    symbols = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("answer_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("symbol_id"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_linestatus").alias("qualified_name"), F.lit("n").alias("name"), F.lit("k").alias("symbol_kind"), F.col("l_linenumber").alias("end_line"))
    keys = ["path", "start_line", "qualified_name"]
    citations = controller.citation_numbers(symbols, keys, "symbol_id").select("answer_id", *keys, "citation").distinct()
    return agent.compact_symbols(symbols, citations).select("answer_id", "symbol_id", "citation")


@query("SELECT doc_id, substr('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}', 1, 20) AS message FROM documents WHERE lang IS NOT NULL")
def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", agent.tool_message(F.struct("doc_id", "lang"), 20).alias("message"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN substr(list_filter([trim(role), 'Other', 'last'], lambda c: lower(c) <> lower('USER') AND lower(c) <> CASE WHEN turn % 2 = 0 THEN 'other' ELSE 'assistant' END)[1], 1, 300) END AS next FROM conversations""")
def replan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.array(F.when(F.col("turn") % 2 == 0, "OTHER").otherwise("Assistant"))
    pick = agent.next_query(F.lit("USER"), F.array(F.col("role"), F.lit(" Other "), F.lit("last")), used, F.col("turn") % 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pick.alias("next"))


@query()
def payload_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects at two depths that carry citations, one for each document."""
    mark = F.concat(F.lit("[C"), (F.col("doc_id") % 5).cast("string"), F.lit("]"))
    inner = F.struct(mark.alias("citation"), F.col("lang").alias("name"))
    payload = F.to_json(F.struct(F.struct(F.array(inner, F.struct(F.lit("none").alias("citation"), F.lit("x").alias("name"))).alias("items"), F.concat(F.lit("see [C9] and "), mark).alias("Citations")).alias("result")))
    return agent.payloads_by_citation(table(spark, sf_dir, "documents").select((F.col("doc_id") % 9).alias("answer_id"), F.col("doc_id").alias("seq"), payload.alias("payload")))


REFS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'page-' || doc_id WHEN 1 THEN 'page-3#table-1' WHEN 2 THEN 'code' WHEN 3 THEN 'run' WHEN 4 THEN 'Head > Sub' ELSE 'document 1' END AS ref, CASE WHEN doc_id % 6 IN (2, 3) THEN 'py' WHEN doc_id % 6 > 3 THEN 'md' ELSE 'pdf' END AS suffix FROM documents"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'page_text' WHEN 1 THEN 'table' WHEN 2 THEN 'code' WHEN 3 THEN 'code' ELSE 'section' END AS element_type, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS INTEGER) WHEN 1 THEN 3 END AS page, CASE WHEN doc_id % 6 = 3 THEN ref END AS symbol, CASE WHEN doc_id % 6 = 4 THEN ref END AS section_path FROM ({REFS})")
def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.element_of(F.col("ref"), F.col("suffix"))
    return own(spark, sf_dir, REFS).withColumn("e", e).select("doc_id", "e.*")


