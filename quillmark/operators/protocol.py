"""What passes between a loop, its tools and its caller: decisions, scope of evidence, transcripts, leases, errors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import strip

# Error codes by status, states worth a retry, what decisions may say, and how transcripts are cut.
ERROR_CODES = {
    400: "BAD_REQUEST", 401: "AUTHENTICATION_REQUIRED", 403: "ACCESS_DENIED", 404: "NOT_FOUND", 405: "METHOD_NOT_ALLOWED", 409: "CONFLICT",
    413: "PAYLOAD_TOO_LARGE", 422: "VALIDATION_ERROR", 429: "RATE_LIMITED", 502: "UPSTREAM_ERROR", 503: "SERVICE_UNAVAILABLE", 504: "UPSTREAM_TIMEOUT",
}
RETRYABLE = [429, 502, 503, 504]
SCOPE_MODES = ["strict_project", "soft_project", "candidate_projects"]
EXPANSIONS = ["none", "rag_allowed", "cross_project_required", "user_confirmation_required"]
TOOL_CHARS, OTHER_CHARS, ALL_CHARS, FIRST, LAST = 5_000, 8_000, 70_000, 2, 12
DECISION = "next_action string, route string, intent string, reason string, scope_mode string, expansion_required string, queries array<string>, sub_questions array<string>, supporting_evidence_ids array<string>, claims array<struct<text: string, evidence_ids: array<string>>>"


def error_code(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv]), status), F.lit("HTTP_ERROR"))


def retryable(status: Column) -> Column:
    return status.isin(RETRYABLE)


def json_object(c: Column, schema: str) -> Column:
    """The object in a model's answer, bare or in a fence; null if it isn't one."""
    body = F.regexp_replace(strip(c), r"(?s)^```[^\n]*\n(.*?)(\n```\s*)?$", "$1")
    return F.when(F.startswith(F.ltrim(body), F.lit("{")), F.from_json(body, schema))


def canonical_arguments(entries: Column) -> Column:
    """A map of arguments as JSON whose keys are sorted, for comparing calls."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def decisions(answers: DataFrame, actions: list[str], routes: list[str]) -> DataFrame:
    """answers (case_id, answer): each decoded decision, cut to its limits, and the first rule that it breaks."""
    d = answers.select("case_id", json_object(F.col("answer"), DECISION).alias("d"))
    clean = lambda name, most: F.slice(F.filter(F.transform(F.coalesce(F.col(f"d.{name}"), F.array().cast("array<string>")), lambda x: F.substring(strip(x), 1, 300)), lambda x: x != ""), 1, most)
    action, route = strip(F.col("d.next_action")), F.nullif(strip(F.coalesce("d.route", F.lit(""))), F.lit(""))
    mode, more = F.coalesce("d.scope_mode", F.lit("soft_project")), F.coalesce("d.expansion_required", F.lit("none"))
    bad_claim = F.exists(F.coalesce("d.claims", F.array().cast("array<struct<text: string, evidence_ids: array<string>>>")), lambda c: (strip(F.coalesce(c["text"], F.lit(""))) == "") | c["evidence_ids"].isNull())
    problem = (
        F.when(F.col("d").isNull(), "not_an_object").when(~F.coalesce(action, F.lit("")).isin(actions), "unsupported_action").when(route.isNotNull() & ~route.isin(routes), "unsupported_route")
        .when((action == "retrieve_rag") & ~F.coalesce(route, F.lit("")).isin("rag", "hybrid"), "route_action_mismatch").when((action == "query_code_wiki") & ~F.coalesce(route, F.lit("")).isin("wiki", "hybrid"), "route_action_mismatch")
        .when(~mode.isin(SCOPE_MODES), "unsupported_scope_mode").when(~more.isin(EXPANSIONS), "unsupported_expansion").when(bad_claim, "bad_claim")
    )
    return d.select("case_id", action.alias("next_action"), route.alias("route"), clean("queries", 3).alias("queries"), clean("sub_questions", 5).alias("sub_questions"), clean("supporting_evidence_ids", 20).alias("supporting_evidence_ids"), F.substring(strip(F.coalesce("d.reason", F.lit(""))), 1, 500).alias("reason"), problem.alias("problem"))


def scope_violations(evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """evidence (loop_id, evidence_id, source_type, project_id, commit_id, anchor_project, anchor_commit) that its loop may
    not use, with the reason; allowed (loop_id, project_id)."""
    joined = evidence.join(allowed.select("loop_id", "project_id", F.lit(True).alias("_ok")).distinct(), ["loop_id", "project_id"], "left")
    reason = (
        F.when((F.col("source_type") == "code_wiki") & (F.col("project_id").isNull() | F.col("commit_id").isNull()), "scope_required")
        .when(F.col("project_id").isNotNull() & F.col("_ok").isNull() & ~F.col("project_id").eqNullSafe(F.col("anchor_project")), "project_mismatch")
        .when(F.col("anchor_commit").isNotNull() & (F.col("project_id") == F.col("anchor_project")) & (F.col("commit_id") != F.col("anchor_commit")), "commit_mismatch")
    )
    return joined.withColumn("reason", reason).filter("reason is not null").drop("_ok")


def compacted(messages: DataFrame) -> DataFrame:
    """messages (transcript_id, nth from 1, role, chars): chars after each is cut; above ALL_CHARS in sum only the first
    and last ones stay. Windows over one transcript."""
    limit = F.when(F.col("role") == "tool", TOOL_CHARS).otherwise(OTHER_CHARS)
    own = messages.withColumn("kept_chars", F.least(F.col("chars"), limit))
    w = Window.partitionBy("transcript_id")
    size, n = F.sum("kept_chars").over(w), F.max("nth").over(w)
    return own.withColumn("_all", size).withColumn("_n", n).filter((F.col("_all") <= ALL_CHARS) | (F.col("nth") <= FIRST) | (F.col("nth") > F.col("_n") - LAST)).drop("_all", "_n")


def lease_checks(times: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """times (key, time, forced) in order: whether each use asks again: the first, forced ones, and those `seconds` or more
    after the last that asked. Arrow batches of a key, one number carried between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            out = []
            for k, t, forced in zip(rows[key], rows["_t"], rows["forced"]):
                if k != at:
                    at, last = k, None
                again = bool(forced) or last is None or t - last >= seconds * 1e6
                last = t if again else last
                out.append(again)
            yield rows.drop(columns="_t").assign(checked=out)

    own = times.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_t")
    return own.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in times.schema) + ", checked boolean")


def evidence_text(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, rank, source_type, source_ref, content): the numbered evidence of each group, in order of rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 类型="), "source_type", F.lit(" 来源="), "source_ref", F.lit("\n"), "content")
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("evidence"))


def question_summary(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, 160)


def folder_name(name: Column) -> Column:
    """A stable folder for a project's name: its safe letters and eight digits of its hash."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), 1, 48)
    return F.concat(F.when(slug == "", "project").otherwise(slug), F.lit("-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 8))


def transfer(tables: dict[str, DataFrame], column: str, source: str, target: str) -> dict[str, DataFrame]:
    """Ownership handed over: in each table, rows of the source user become the target's."""
    return {n: df.withColumn(column, F.when(F.col(column) == source, target).otherwise(F.col(column))) for n, df in tables.items()}


def upsert_invitations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Invitations (workspace_id, normalized_email, role, token_hash, expires_at, accepted_at, revoked_at): an incoming one
    takes the place of the open one for the same workspace and address; closed ones stay."""
    keys = ["workspace_id", "normalized_email"]
    still = F.col("accepted_at").isNull() & F.col("revoked_at").isNull()
    open_ = existing.filter(still).join(incoming.select(*keys), keys, "left_anti")
    return existing.filter(~still).unionByName(open_).unionByName(incoming.select(*existing.columns))
