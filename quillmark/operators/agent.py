"""The state of a knowledge loop as rows: what each event does to it, and what may be done next.

A loop's events are few (its budgets bound them), so state is a fold over one loop's ordered events; many loops run side
by side. What does not depend on what came before is an expression or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Modes and their capabilities, what an empty answer says.
CAPABILITIES = {"auto": ["retrieve_rag", "query_code_wiki"], "rag": ["retrieve_rag"], "codewiki": ["query_code_wiki"], "hybrid": ["retrieve_rag", "query_code_wiki"]}
NO_ANSWER = "当前证据不足以形成经过验证的回答。"
COUNTED = ["items", "nodes", "facts", "links", "edges", "outgoing", "incoming"]
OPEN_POLICIES = ["allow_authorized", "candidate_set"]

#: Reasons for which a loop is closed for good; a refused call alone does not close it.
CLOSING = ["max_tool_calls_exceeded", "project_scope_required"]


def admitted_actions(calls: DataFrame, max_calls: int = 8) -> DataFrame:
    """calls (loop_id, seq, action, signature, requires_project boolean, project_id or null): admitted, reason.

    In this order: a loop that has been closed, the budget, a project that is needed and not there, a signature that was
    admitted before. The budget and the missing project close the loop.
    """
    item = F.struct("seq", "signature", (F.col("requires_project") & F.col("project_id").isNull()).alias("lacks"))
    lists = calls.groupBy("loop_id").agg(F.sort_array(F.collect_list(item)).alias("calls"))
    out = "array<struct<seq: bigint, admitted: boolean, reason: string>>"
    start = F.expr(f"cast(named_struct('n', 0, 'seen', array(), 'closed', false, 'out', array()) as struct<n: int, seen: array<string>, closed: boolean, out: {out}>)")

    def step(acc: Column, c: Column) -> Column:
        reason = F.when(acc["closed"], "closed").when(acc["n"] >= max_calls, CLOSING[0]).when(c["lacks"], CLOSING[1]).when(F.array_contains(acc["seen"], c["signature"]), "duplicate")
        ok = reason.isNull()
        row = F.struct(c["seq"].cast("long").alias("seq"), ok.alias("admitted"), reason.alias("reason"))
        return F.struct(
            F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(ok, F.array_append(acc["seen"], c["signature"])).otherwise(acc["seen"]).alias("seen"),
            (acc["closed"] | F.coalesce(reason.isin(*CLOSING), F.lit(False))).alias("closed"), F.array_append(acc["out"], row).alias("out"),
        )

    return lists.select("loop_id", F.inline(F.aggregate("calls", start, step, lambda acc: acc["out"])))


def child_budgets(reports: DataFrame, max_calls: int, max_rounds: int) -> DataFrame:
    """reports (loop_id, tool_calls, rounds, used_tool_calls, used_rounds) of children, summed into their loop's budget:
    used_tool_calls, used_rounds, stop_reason. Negative counts are none."""
    spent = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))))
    rows = reports.groupBy("loop_id").agg((F.max("used_tool_calls") + spent("tool_calls")).alias("used_tool_calls"), (F.max("used_rounds") + spent("rounds")).alias("used_rounds"))
    return rows.withColumn("stop_reason", F.when(F.col("used_tool_calls") > max_calls, "max_tool_calls_exceeded").when(F.col("used_rounds") > max_rounds, "max_rounds_exceeded"))


def narrowed_scope(suggested: Column, project_id: Column, policy: Column) -> Column:
    """What becomes of a suggested scope: struct<scope_mode, expansion_required>. A suggestion never widens what the
    server allows."""
    row = lambda mode, need: F.struct(F.lit(mode).alias("scope_mode"), need.alias("expansion_required"))
    candidates = F.when(policy.isin(*OPEN_POLICIES), "cross_project_required").otherwise("user_confirmation_required")
    return F.when((suggested == "strict_project") & project_id.isNotNull(), row("strict_project", F.lit("none"))).when(suggested == "candidate_projects", row("candidate_projects", candidates)).otherwise(row("soft_project", F.when(project_id.isNotNull(), "rag_allowed").otherwise("none")))


def may_expand(policy: Column, allowed: Column, project_id: Column) -> Column:
    return policy.isin(*OPEN_POLICIES) & F.array_contains(allowed, project_id)


def decided(decisions: DataFrame) -> DataFrame:
    """decisions (loop_id, seq, next_action, route, intent, reason, claims array) in order: each loop's state after the
    last: next_action, answer_ready, refused, phase, stop_reason, route, intent, claims, decision_count.

    The last action decides; routes and intents stay until another is given; claims are those of the last answer.
    """
    order = F.col("seq")
    last = decisions.groupBy("loop_id").agg(
        F.max_by("next_action", order).alias("next_action"), F.max_by("reason", order).alias("_reason"), F.count("*").alias("decision_count"),
        F.max_by("route", F.when(F.col("route").isNotNull(), order)).alias("route"), F.max_by(F.coalesce("intent", "route"), F.when(F.coalesce("intent", "route").isNotNull(), order)).alias("intent"),
        F.max_by("claims", F.when(F.col("next_action") == "answer", order)).alias("claims"),
    )
    action = F.col("next_action")
    phase = F.when(action == "answer", "finish").when(action == "refuse", "refuse").when(action == "replan", "replan").otherwise("execute")
    stop = F.when(action == "answer", "evidence_sufficient").when(action == "refuse", F.coalesce(F.when(F.col("_reason") != "", F.col("_reason")), F.lit("evidence_insufficient")))
    return last.select("loop_id", "next_action", (action == "answer").alias("answer_ready"), (action == "refuse").alias("refused"), phase.alias("phase"), stop.alias("stop_reason"), "route", "intent", "claims", "decision_count")


def closed(state: DataFrame, ready: Column, refused_for: Column) -> DataFrame:
    """state (answer_ready, refused, phase, next_action, stop_reason) with loops marked ready, or refused for a reason
    that is not null; a refusal wins."""
    no, yes = refused_for.isNotNull(), ready & refused_for.isNull()
    put = lambda column, refuse, answer: F.when(no, refuse).when(yes, answer).otherwise(F.col(column))
    return state.withColumns({"answer_ready": put("answer_ready", F.lit(False), F.lit(True)), "refused": put("refused", F.lit(True), F.lit(False)), "phase": put("phase", F.lit("refuse"), F.lit("finish")), "next_action": put("next_action", F.lit("refuse"), F.lit("answer")), "stop_reason": put("stop_reason", refused_for, F.lit("evidence_sufficient"))})


def attempts(admitted: DataFrame) -> DataFrame:
    """admitted (loop_id, signature, e.g. `action:query`): how often each loop tried each action."""
    return admitted.groupBy("loop_id", F.substring_index("signature", ":", 1).alias("action")).agg(F.count_distinct("signature").alias("attempts"))


def possible_actions(mode: Column, strict: Column, has_project: Column, left: Column, tried: Column, has_evidence: Column, most: int = 2) -> Column:
    """What a loop may do next, sorted: knowledge actions of its mode that were tried less than `most` times, then answer
    with evidence, replan while paths remain, else refuse. tried: map of action to attempts; left: calls in the budget."""
    of_mode = F.element_at(F.create_map(*[x for k, v in CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), mode)
    usable = F.filter(of_mode, lambda a: ((a != "query_code_wiki") | has_project) & ((a != "retrieve_rag") | ~(strict | (mode == "codewiki"))) & (left > 0))
    open_ = F.filter(usable, lambda a: F.coalesce(F.try_element_at(tried, a), F.lit(0)) < most)
    more = F.when(F.size(open_) > 0, F.array(F.lit("replan"))).otherwise(F.array(F.lit("refuse")))
    return F.sort_array(F.concat(open_, more, F.when(has_evidence, F.array(F.lit("answer"))).otherwise(F.array().cast("array<string>"))))


def fallback_action(possible: Column, target: Column) -> Column:
    """What to do without a planner: code if a project is certain, else documents, else refuse."""
    return F.when(target.isNotNull() & F.array_contains(possible, F.lit("query_code_wiki")), "query_code_wiki").when(F.array_contains(possible, F.lit("retrieve_rag")), "retrieve_rag").otherwise("refuse")


def missing_capabilities(mode: Column, succeeded: Column) -> Column:
    """Capabilities that a hybrid answer still needs a success of; other modes need any one."""
    both = F.array(*map(F.lit, CAPABILITIES["hybrid"]))
    return F.when(mode == "hybrid", F.array_except(both, succeeded)).when(F.size(succeeded) == 0, both).otherwise(F.array().cast("array<string>"))


def stopped(rounds: DataFrame, max_calls: int, max_rounds: int, stale_limit: int = 2) -> DataFrame:
    """rounds (loop_id, round, executed, blocked or null, progress boolean): the transition after each round: unchanged,
    tool_calls, stop_reason or null. Once stopped, a loop keeps its first reason.

    First comes a round in which everything was blocked, then rounds without progress, the call and the round budget.
    Rounds that ran nothing change no count. Running sums over one loop's rounds, which the budget bounds.
    """
    w = Window.partitionBy("loop_id").orderBy("round")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ran, moved = F.col("executed") > 0, F.col("progress")
    rows = rounds.withColumns({"tool_calls": F.sum("executed").over(so_far), "_moves": F.sum(F.when(ran & moved, 1).otherwise(0)).over(so_far)})
    rows = rows.withColumn("unchanged", F.sum(F.when(ran & ~moved, 1).otherwise(0)).over(Window.partitionBy("loop_id", "_moves").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))
    now = F.when(F.col("blocked").isNotNull() & ~ran, F.col("blocked")).when(F.col("unchanged") >= stale_limit, "no_new_evidence").when(F.col("tool_calls") >= max_calls, "tool_budget_exhausted").when(F.col("round") + 1 >= max_rounds, "round_budget_exhausted")
    return rows.withColumn("_now", now).withColumn("stop_reason", F.first("_now", ignorenulls=True).over(so_far)).drop("_now", "_moves")


def usable_evidence(result: Column) -> Column:
    """How many facts a tool's result (JSON text) gives: its lists' entries and its source; a bare count is one, an error
    none."""
    size = lambda k: F.coalesce(F.when(F.startswith(F.get_json_object(result, f"$.{k}"), F.lit("[")), F.json_array_length(F.get_json_object(result, f"$.{k}"))), F.lit(0))
    said = lambda k: F.coalesce(F.get_json_object(result, f"$.{k}"), F.lit("")).isin("", "null", "0", "false", "[]", "{}")
    total = sum((size(k) for k in COUNTED), F.lit(0)) + F.when(~said("source") | ~said("numbered_content"), 1).otherwise(0)
    return F.when(~said("error"), 0).when(total > 0, total).otherwise(F.when(said("count"), 0).otherwise(1)).cast("long")


def rendered_claims(claims: DataFrame) -> DataFrame:
    """claims (case_id, ordinal, text, evidence_ids) as a cautious answer: one line a claim with its citations."""
    ids = F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), " ")
    line = F.rtrim(F.concat(F.lit("- "), F.col("text"), F.lit(" "), ids))
    lists = claims.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lists.select("case_id", F.when(text == "", NO_ANSWER).otherwise(text).alias("answer"))


def public(state: DataFrame) -> DataFrame:
    """What a browser may see of a loop's state: no question, evidence text or tool results; lists only as their sizes."""
    kept = ["request_id", "loop_id", "phase", "project_id", "commit_id", "max_rounds", "max_tool_calls", "used_rounds", "used_tool_calls", "route", "intent", "missing_information", "next_action", "answer_ready", "refused", "stop_reason", "decision_count"]
    sizes = [F.size(c).alias(f"{n}_count") for c, n in (("evidence", "evidence"), ("tool_results", "tool_result")) if c in state.columns]
    return state.select(*[c for c in kept if c in state.columns], *sizes)


def cited_evidence(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations (answer_id, citation) with the evidence of that id, null where there is none."""
    return citations.join(evidence.withColumnRenamed("evidence_id", "citation"), ["answer_id", "citation"], "left")


def source_rows(hits: DataFrame) -> DataFrame:
    """hits (chunk_id, source_name, source_ref, score, similarity, rerank_score) as a reader sees them: names by default,
    scores rounded to 4 and 6 places."""
    number = lambda c, places: F.round(F.coalesce(F.col(c), F.lit(0.0)), places).alias(c)
    return hits.select("chunk_id", F.coalesce("source_name", F.lit("RAG 文档")).alias("source_name"), F.coalesce("source_ref", F.lit("")).alias("source_ref"), number("similarity", 4), number("rerank_score", 6), number("score", 6))


def compact_symbols(symbols: DataFrame, citations: DataFrame) -> DataFrame:
    """symbols (answer_id, symbol_id, name, qualified_name, symbol_kind, path, start_line, end_line) with their citation
    (citations: answer_id, path, start_line, qualified_name, citation) in brackets, and nothing else."""
    rows = symbols.join(citations, ["answer_id", "path", "start_line", "qualified_name"])
    return rows.select("answer_id", F.concat(F.lit("[C"), F.col("citation").cast("string"), F.lit("]")).alias("citation"), "symbol_id", "name", "qualified_name", F.col("symbol_kind").alias("kind"), "path", "start_line", "end_line")


def tool_message(result: Column, most: int = 30_000) -> Column:
    """A tool's result (a struct) as JSON text, cut at `most` characters."""
    return F.substring(F.to_json(result), 1, most)


def next_query(question: Column, candidates: Column, used: Column, replans: Column, most: int = 2, longest: int = 300) -> Column:
    """The first candidate wording that was not used yet, cut; null once the replans are spent or none is left."""
    fresh = F.filter(F.transform(candidates, lambda c: F.trim(c)), lambda c: (c != "") & ~F.array_contains(F.transform(F.array_append(used, question), lambda u: F.lower(u)), F.lower(c)))
    return F.when(replans < most, F.substring(F.get(fresh, F.lit(0)), 1, longest))


def payloads_by_citation(payloads: DataFrame, most: int = 4_000) -> DataFrame:
    """payloads (answer_id, seq, payload as JSON text): citation, nth, content: every object in which a key named like
    `citation` holds marks such as [C1], at any depth, as compact JSON cut at `most` characters."""
    import json
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    def objects(value: object) -> Iterator[dict]:
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                yield x
                todo += reversed(list(x.values()))
            elif isinstance(x, list):
                todo += reversed(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for answer, seq, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    payload = json.loads(text or "null")
                except ValueError:
                    continue
                payload = payload.get("result", payload) if isinstance(payload, dict) else payload
                for nth, x in enumerate(objects(payload)):
                    marks = {m for k, v in x.items() if "citation" in k.casefold() for m in re.findall(r"\[(C\d+)\]", str(v))}
                    out += [(answer, m, seq, nth, json.dumps(x, ensure_ascii=False)[:most]) for m in sorted(marks)]
            cols = list(zip(*out)) if out else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["answer_id", "citation", "seq", "nth", "content"])

    own = payloads.select(F.col("answer_id").cast("long"), F.col("seq").cast("long"), F.col("payload").cast("string"))
    return own.mapInArrow(run, "answer_id long, citation string, seq long, nth int, content string")
