"""Agent loop, gate, packing, contract and stream frame queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import controller, layout
from quillmark.plans.registry import own, query, table
from quillmark.streaming import framing

# each turn is a frame, cut in the middle of its second line
PIECES = "SELECT conv_id AS stream_id, turn * 2 AS seq, 'event: ' || role || chr(10) || 'da' AS body FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, 'ta: ' || replace(text, chr(10), ' ') || chr(10) || chr(10) FROM conversations"


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, role AS event, trim(replace(text, chr(10), ' ')) AS data, turn * 2 + 1 AS seq FROM conversations")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.frames(own(spark, sf_dir, PIECES))


CITED = "SELECT conv_id * 1000 + turn + 10 AS id, text || ' [E' || turn % 3 || '] and [' || role || '-' || conv_id % 2 || '] [' || role || '!]' AS answer, 'E0|E1|user-0|assistant-0' AS allowed, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'E1' END AS required FROM conversations UNION ALL SELECT * FROM (VALUES (1, 'one [E1] and [E2], again [E1]', 'E1|E2', 'E1'), (2, 'none', 'E1', 'E1'), (3, 'bad [X9]', 'E1', ''), (4, '[a-b_c] [1]', '1|a-b_c', '1')) AS t(id, answer, allowed, required)"


@query(f"""WITH c AS (SELECT id, list_sort(list_distinct(regexp_extract_all(answer, '\\[([A-Za-z0-9][A-Za-z0-9_-]{{0,80}})\\]', 1))) AS cited, string_split(allowed, '|') AS a, list_filter(string_split(required, '|'), lambda x: x <> '') AS r FROM ({CITED}))
SELECT id, array_to_string(cited, ',') AS cited, len(list_filter(cited, lambda x: NOT list_contains(a, x))) = 0 AS all_allowed, len(list_filter(r, lambda x: NOT list_contains(cited, x))) = 0 AS required_cited FROM c""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = T.citations(F.col("answer"))
    required = F.filter(F.split("required", "[|]"), lambda x: x != "")
    return own(spark, sf_dir, CITED).select("id", F.array_join(cited, ",").alias("cited"), (F.size(F.array_except(cited, F.split("allowed", "[|]"))) == 0).alias("all_allowed"), (F.size(F.array_except(required, cited)) == 0).alias("required_cited"))


EVIDENCE = """SELECT conv_id + 10 AS case_id, 'E' || turn AS evidence_id, CASE conv_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'error' ELSE 'success' END AS status, CASE WHEN turn % 2 = 0 THEN 'retrieve_rag' ELSE 'query_code_wiki' END AS capability, CASE WHEN turn % 2 = 0 THEN 'rag' ELSE 'code_wiki' END AS source_type, role AS locator, text AS content, conv_id % 11 <> 0 AS project_allowed, CASE WHEN conv_id % 13 <> 0 THEN 'c' END AS commit_id FROM conversations
 UNION ALL SELECT * FROM (VALUES
 (1, 'E1', 'success', 'retrieve_rag', 'rag', 'doc#1', 'text', true, 'c'), (1, 'E2', 'partial', 'query_code_wiki', 'code_wiki', 'a.py:3', 'fact', true, 'c'), (2, 'E1', 'success', 'retrieve_rag', 'rag', 'doc#1', 'text', true, 'c'),
 (3, 'E1', 'error', 'retrieve_rag', 'rag', 'doc#1', 'text', true, 'c'), (4, 'E1', 'success', 'query_code_wiki', 'code_wiki', 'a.py', 'f', false, 'c'), (5, 'E1', 'success', 'retrieve_rag', 'rag', '', 'text', true, 'c'), (6, 'E1', 'success', 'retrieve_rag', 'rag', 'd', 't', true, 'c')
) AS t(case_id, evidence_id, status, capability, source_type, locator, content, project_allowed, commit_id)"""
CLAIMS = "SELECT conv_id + 10 AS case_id, turn + 1 AS claim_id, 'claim' AS text, CASE WHEN turn = 0 THEN 'E0' ELSE 'E0|E' || turn END AS ids FROM conversations WHERE turn < 2 UNION ALL SELECT * FROM (VALUES (1, 1, 'claim one', 'E1'), (1, 2, 'claim two', 'E1|E2'), (2, 1, 'claim', 'E9'), (3, 1, 'claim', 'E1'), (4, 1, 'claim', 'E1'), (5, 1, 'claim', 'E1'), (6, 1, 'claim', 'E1')) AS t(case_id, claim_id, text, ids)"
ASKED = "SELECT conv_id + 10 AS case_id, CASE WHEN conv_id % 7 = 0 THEN 'E0|E9' ELSE 'E0|E1' END AS ids FROM conversations GROUP BY conv_id UNION ALL SELECT * FROM (VALUES (1, 'E1|E2'), (2, 'E9'), (3, 'E1'), (4, 'E1'), (5, 'E1'), (6, 'E1|E2'), (7, 'E1')) AS t(case_id, ids)"


@query(f"""WITH have AS (SELECT case_id, evidence_id FROM ({EVIDENCE}) WHERE (status = 'success' OR (status = 'partial' AND capability = 'query_code_wiki')) AND locator <> '' AND trim(content) <> '' AND (source_type <> 'code_wiki' OR (project_allowed AND commit_id IS NOT NULL))),
c AS (SELECT case_id, claim_id, text, unnest(string_split(ids, '|')) AS id FROM ({CLAIMS})), a AS (SELECT case_id, unnest(string_split(ids, '|')) AS id FROM ({ASKED}))
SELECT q.case_id, EXISTS (SELECT 1 FROM c WHERE c.case_id = q.case_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = q.case_id AND NOT EXISTS (SELECT 1 FROM have h WHERE h.case_id = c.case_id AND h.evidence_id = c.id))
 AND NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = q.case_id AND c.id NOT IN (SELECT id FROM a WHERE a.case_id = q.case_id)) AND NOT EXISTS (SELECT 1 FROM a WHERE a.case_id = q.case_id AND a.id NOT IN (SELECT id FROM c WHERE c.case_id = q.case_id)) AS can_answer FROM ({ASKED}) q""")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.split("ids", "[|]").alias("evidence_ids")
    return controller.answerable(own(spark, sf_dir, EVIDENCE), own(spark, sf_dir, CLAIMS).select("case_id", "claim_id", "text", ids), own(spark, sf_dir, ASKED).select("case_id", ids))


PACKED = "SELECT conv_id AS case_id, turn AS ordinal, CASE length(text) % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'b|c' WHEN 2 THEN 'c' ELSE 'c|d' END AS ids FROM conversations"


@query(f"""WITH RECURSIVE c AS (SELECT case_id, ordinal, string_split(ids, '|') AS ids, row_number() OVER (PARTITION BY case_id ORDER BY ordinal) AS r FROM ({PACKED})),
w AS (SELECT case_id, 0::BIGINT AS r, 0::BIGINT AS ordinal, 0::BIGINT AS used, CAST([] AS VARCHAR[]) AS seen, false AS taken FROM (SELECT DISTINCT case_id FROM c)
 UNION ALL SELECT case_id, r, ordinal, CASE WHEN ok THEN used + more ELSE used END, CASE WHEN ok THEN list_concat(seen, fresh) ELSE seen END, ok FROM (
  SELECT *, NOT list_contains(fresh, 'd') AND used + more <= 200 AS ok FROM (
   SELECT *, CASE WHEN list_contains(fresh, 'a') THEN 42 + case_id % 50 ELSE 0 END + CASE WHEN list_contains(fresh, 'b') THEN 92 ELSE 0 END + CASE WHEN list_contains(fresh, 'c') THEN 62 + case_id % 7 ELSE 0 END + CASE WHEN list_contains(fresh, 'd') THEN 2 ELSE 0 END AS more FROM (
    SELECT c.case_id, c.r, c.ordinal, w.used, w.seen, list_filter(c.ids, lambda x: NOT list_contains(w.seen, x)) AS fresh FROM w JOIN c ON c.case_id = w.case_id AND c.r = w.r + 1))))
SELECT case_id, ordinal, taken, used AS used_chars FROM w WHERE r > 0""")
def claim_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as claims on its pieces of evidence, of which the last is not known."""
    turns = table(spark, sf_dir, "conversations")
    n = F.length("text") % 4
    ids = F.when(n == 0, F.array(F.lit("a"), F.lit("b"))).when(n == 1, F.array(F.lit("b"), F.lit("c"))).when(n == 2, F.array(F.lit("c"))).otherwise(F.array(F.lit("c"), F.lit("d")))
    claims = turns.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), ids.alias("evidence_ids"))
    case = F.col("case_id")
    sizes = F.explode(F.array(F.struct(F.lit("a").alias("e"), (case % 50 + 40).alias("n")), F.struct(F.lit("b").alias("e"), F.lit(90).cast("long").alias("n")), F.struct(F.lit("c").alias("e"), (case % 7 + 60).alias("n")))).alias("x")
    evidence = claims.select("case_id").distinct().select("case_id", sizes).select("case_id", F.col("x.e").alias("evidence_id"), F.col("x.n").alias("length"))
    return controller.pack_claims(claims, evidence, 200)


ANSWERED = "SELECT conv_id * 1000 + turn AS case_id, role, CASE turn % 4 WHEN 0 THEN '- ' || role || ' said [E1]' WHEN 1 THEN role || ' said [E9]' WHEN 2 THEN role || ' said' ELSE 'Other words [E1]' END AS answer FROM conversations"


@query("SELECT conv_id * 1000 + turn AS case_id, CASE turn % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'unapproved_citation' WHEN 2 THEN 'missing_required_citation' ELSE 'claim_text_or_mapping_changed' END AS reason FROM conversations")
def answer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.lit("E1"))
    claims = F.array(F.struct(F.concat("role", F.lit(" said")).alias("text"), ids.alias("evidence_ids"))).alias("claims")
    return controller.contract(own(spark, sf_dir, ANSWERED).select("case_id", "answer", claims, ids.alias("allowed"))).select("case_id", "reason")


RESULTS = "SELECT user_id + 10 AS loop_id, event_id AS seq, CAST(floor(event_id / 700) AS INTEGER) AS round, event_type || event_id % 3 AS fingerprint, CAST(event_id % 4 AS INTEGER) AS evidence_count FROM events UNION ALL SELECT * FROM (VALUES (1, 1, 1, 'a', 2), (1, 2, 1, 'b', 0), (1, 3, 2, 'a', 3), (1, 4, 3, 'c', 0), (1, 5, 4, 'd', 1), (2, 1, 1, 'a', 0), (2, 2, 2, 'b', 0), (2, 3, 3, 'b', 4)) AS t(loop_id, seq, round, fingerprint, evidence_count)"


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY loop_id, fingerprint ORDER BY seq) = 1 AND evidence_count > 0 AS moved FROM ({RESULTS})),
r AS (SELECT loop_id, round, count(*) AS n_results, bool_or(moved) AS progress FROM p GROUP BY loop_id, round), g AS (SELECT *, sum(progress::INT) OVER (PARTITION BY loop_id ORDER BY round) AS k FROM r)
SELECT loop_id, round, n_results, progress, s AS stale_rounds, CASE WHEN s >= 2 THEN 'no_new_evidence' END AS stop_reason FROM (SELECT *, CAST(sum((NOT progress)::INT) OVER (PARTITION BY loop_id, k ORDER BY round) AS BIGINT) AS s FROM g)""")
def loop_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controller.progress(own(spark, sf_dir, RESULTS))


ADMITTED = "SELECT user_id * 100 + day(ts) AS loop_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'list_project_files' ELSE event_type END AS name, 'q' || event_id % 4 AS arguments, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS query, 0 AS page_offset, event_id % 5 < 2 AS progress, CAST(event_id // 900 AS INTEGER) AS round FROM events"


@query(f"""WITH RECURSIVE o AS (SELECT *, name || arguments AS sig, name = 'list_project_files' AND trim(query) = '' AS whole, row_number() OVER (PARTITION BY loop_id ORDER BY seq) AS r FROM ({ADMITTED})),
w AS (SELECT loop_id, 0::BIGINT AS r, 0::BIGINT AS seq, 0 AS n, CAST([] AS VARCHAR[]) AS sigs, false AS listed, 0 AS stale, CAST(NULL AS INTEGER) AS round, false AS ran, false AS moved, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT loop_id FROM o)
 UNION ALL SELECT loop_id, r, seq, n + (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN list_append(sigs, sig) ELSE sigs END, listed OR (reason IS NULL AND name = 'list_project_files'), stale, now_round, (ran AND NOT turn) OR reason IS NULL, (moved AND NOT turn) OR (reason IS NULL AND progress), reason FROM (
  SELECT *, CASE WHEN n >= 50 THEN 'tool_budget_exhausted' WHEN whole AND listed THEN 'project_files_already_inspected' WHEN list_contains(sigs, sig) THEN 'same_query_repeated' WHEN stale >= 2 THEN 'no_new_evidence' END AS reason FROM (
   SELECT o.loop_id, o.r, o.seq, o.sig, o.whole, o.name, o.progress, o.round AS now_round, w.n, w.sigs, w.listed, w.ran, w.moved, coalesce(w.round <> o.round, false) AS turn, CASE WHEN coalesce(w.round <> o.round, false) AND w.ran THEN CASE WHEN w.moved THEN 0 ELSE w.stale + 1 END ELSE w.stale END AS stale FROM w JOIN o ON o.loop_id = w.loop_id AND o.r = w.r + 1)))
SELECT loop_id, seq, reason IS NULL AS admitted, reason FROM w WHERE r > 0""")
def loop_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the calls of a loop."""
    at = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("loop_id"), at.alias("seq"), F.when(at % 3 == 0, "list_project_files").otherwise(F.col("event_type")).alias("name"), F.concat(F.lit("q"), (at % 4).cast("string")).alias("arguments"),
        F.when(at % 2 == 0, "").otherwise("x").alias("query"), F.lit(0).alias("page_offset"), (at % 5 < 2).alias("progress"), F.floor(at / 900).cast("int").alias("round"),
    )
    return controller.admissions(calls)


DELTAS = "SELECT conv_id + 10 AS stream_id, turn AS seq, turn % 2 AS call_index, CASE WHEN turn < 2 THEN 'c' || conv_id END AS id, CASE WHEN turn < 2 THEN role END AS name, text AS arguments FROM conversations UNION ALL SELECT * FROM (VALUES (1, 1, 0, 'c1', 'search', '{\"q\":'), (1, 2, 0, NULL, NULL, '\"a\"}'), (1, 3, 1, 'c2', 'finish', '{'), (1, 4, 1, NULL, NULL, '}'), (2, 1, 0, 'd1', 'search', NULL)) AS t(stream_id, seq, call_index, id, name, arguments)"


@query(f"SELECT stream_id, call_index, arg_min(id, seq) AS id, arg_min(name, seq) AS name, coalesce(string_agg(arguments, '' ORDER BY seq), '') AS arguments FROM ({DELTAS}) GROUP BY stream_id, call_index")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controller.merge_deltas(own(spark, sf_dir, DELTAS))


@query()
def page_decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a page, its words set in lines of ten."""
    at = F.col("i")
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.posexplode(F.split("text", "[ \\n]+")).alias("i", "text")).filter("text <> ''")
    x, top = (40.0 + at % 10 * 50).alias("x0"), (60.0 + F.floor(at / 10) * 12).cast("double")
    return layout.page_text(layout.lines(words.select("doc_id", "page", F.lit(600.0).alias("width"), F.greatest(F.lit(800.0), top + 60).alias("height"), x, (80.0 + at % 10 * 50).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), "text")))
