"""Deterministic parts of an agent loop as folds and checks over tables: admission, progress, gates, packing, contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import CITATION, citations

#: Answer budget in characters for each context token; separators between packed parts.
CHARS_PER_TOKEN, SEPARATOR = 4, 2


def admissions(calls: DataFrame, max_calls: int = 50, listing: str = "list_project_files") -> DataFrame:
    """calls (loop_id, seq, name, arguments, query, page_offset, progress boolean, round): whether each is admitted.

    In order: budget, a full listing already made, an equal call already made, two rounds without progress. The fold
    runs over one loop's ordered calls, which the budget bounds. Returns loop_id, seq, admitted, reason.
    """
    item = F.struct("seq", "name", F.sha2(F.concat_ws("\u0001", "name", "arguments"), 256).alias("sig"), ((F.col("name") == listing) & (F.coalesce(F.trim("query"), F.lit("")) == "") & (F.coalesce("page_offset", F.lit(0)) == 0)).alias("full"), F.col("progress").alias("progress"), "round")
    lists = calls.groupBy("loop_id").agg(F.sort_array(F.collect_list(item)).alias("calls"))
    state = "struct<n: int, sigs: array<string>, listed: boolean, stale: int, round: int, ran: boolean, moved: boolean, out: array<struct<seq: bigint, admitted: boolean, reason: string>>>"
    start = F.expr(f"cast(named_struct('n', 0, 'sigs', array(), 'listed', false, 'stale', 0, 'round', cast(null as int), 'ran', false, 'moved', false, 'out', array()) as {state})")

    def step(acc: Column, c: Column) -> Column:
        turn = acc["round"].isNotNull() & (acc["round"] != c["round"])
        stale = F.when(turn & acc["ran"], F.when(acc["moved"], 0).otherwise(acc["stale"] + 1)).otherwise(acc["stale"])
        reason = (
            F.when(acc["n"] >= max_calls, "tool_budget_exhausted").when(c["full"] & acc["listed"], "project_files_already_inspected")
            .when(F.array_contains(acc["sigs"], c["sig"]), "same_query_repeated").when(stale >= 2, "no_new_evidence")
        )
        ok = reason.isNull()
        keep = F.when(turn, F.lit(False))
        row = F.struct(c["seq"].cast("long").alias("seq"), ok.alias("admitted"), reason.alias("reason"))
        return F.struct(
            (acc["n"] + ok.cast("int")).alias("n"), F.when(ok, F.array_append(acc["sigs"], c["sig"])).otherwise(acc["sigs"]).alias("sigs"), (acc["listed"] | (ok & (c["name"] == listing))).alias("listed"), stale.alias("stale"), c["round"].cast("int").alias("round"),
            (F.coalesce(keep, acc["ran"]) | ok).alias("ran"), (F.coalesce(keep, acc["moved"]) | (ok & c["progress"])).alias("moved"), F.array_append(acc["out"], row).alias("out"),
        ).cast(state)

    return lists.select("loop_id", F.inline(F.aggregate("calls", start, step, lambda acc: acc["out"])))


def progress(results: DataFrame) -> DataFrame:
    """results (loop_id, seq, round, fingerprint, evidence_count): whether each is new and has evidence, and for each
    round the number of rounds in a row without any (counted from the last one with)."""
    nth = F.row_number().over(Window.partitionBy("loop_id", "fingerprint").orderBy("seq"))
    moved = results.withColumn("progress", (nth == 1) & (F.col("evidence_count") > 0))
    rounds = moved.groupBy("loop_id", "round").agg(F.count("*").alias("n_results"), F.bool_or("progress").alias("progress"))
    by_round = Window.partitionBy("loop_id").orderBy("round")
    island = rounds.withColumn("_g", F.sum(F.col("progress").cast("int")).over(by_round))
    stale = F.sum((~F.col("progress")).cast("int")).over(Window.partitionBy("loop_id", "_g").orderBy("round"))
    return island.withColumn("stale_rounds", stale.cast("long")).withColumn("stop_reason", F.when(F.col("stale_rounds") >= 2, "no_new_evidence")).drop("_g")


def answerable(evidence: DataFrame, claims: DataFrame, requested: DataFrame) -> DataFrame:
    """The answer gate for each case.

    evidence (case_id, evidence_id, status, capability, source_type, locator, content, project_allowed, commit_id),
    claims (case_id, claim_id, text, evidence_ids), requested (case_id, evidence_ids): an answer may be given if there
    are claims, each with a text and ids that are all available, and the ids they name are just those requested.
    Available is evidence from a success (or a part of one, of code) with locator and content; of code, from an
    allowed project at a commit.
    """
    code = F.col("source_type") == "code_wiki"
    usable = (F.col("status") == "success") | ((F.col("status") == "partial") & (F.col("capability") == "query_code_wiki"))
    good = evidence.filter(usable & (F.coalesce("locator", F.lit("")) != "") & (F.trim(F.coalesce("content", F.lit(""))) != "") & (~code | (F.col("project_allowed") & F.col("commit_id").isNotNull())))
    have = good.groupBy("case_id").agg(F.collect_set("evidence_id").alias("have"))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    checked = claims.join(have, "case_id", "left").withColumn("ok", (F.coalesce("text", F.lit("")) != "") & (F.size("evidence_ids") > 0) & inside(F.col("evidence_ids"), F.coalesce("have", F.array().cast("array<string>"))))
    mapped = checked.groupBy("case_id").agg(F.bool_and("ok").alias("all_ok"), F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("mapped"))
    both = requested.join(mapped, "case_id", "left")
    asked = F.array_distinct("evidence_ids")
    return both.select("case_id", F.coalesce(F.col("all_ok") & (F.size(asked) > 0) & inside(asked, F.col("mapped")) & inside(F.col("mapped"), asked), F.lit(False)).alias("can_answer"))


def pack_claims(claims: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """claims (case_id, ordinal, evidence_ids) in order; a claim is taken if all its evidence (case_id, evidence_id,
    length) is known and what isn't packed yet fits. A claim that doesn't fit is skipped, later ones may.
    Returns case_id, ordinal, taken, used_chars after it."""
    sizes = evidence.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", F.col("length").cast("long")))).alias("sizes"))
    lists = claims.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "evidence_ids"))).alias("claims")).join(sizes, "case_id", "left")
    state = "struct<used: bigint, ids: array<string>, out: array<struct<ordinal: bigint, taken: boolean, used_chars: bigint>>>"
    start = F.expr(f"cast(named_struct('used', 0L, 'ids', array(), 'out', array()) as {state})")

    def step(acc: Column, c: Column) -> Column:
        fresh = F.array_except(c["evidence_ids"], acc["ids"])
        known = F.coalesce(F.size(F.array_except(fresh, F.map_keys("sizes"))) == 0, F.size(fresh) == 0)
        more = F.aggregate(fresh, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(F.try_element_at(F.col("sizes"), e), F.lit(0).cast("long")) + SEPARATOR)
        taken = known & (acc["used"] + more <= budget)
        used = F.when(taken, acc["used"] + more).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.when(taken, F.concat(acc["ids"], fresh)).otherwise(acc["ids"]).alias("ids"), F.array_append(acc["out"], F.struct(c["ordinal"].cast("long").alias("ordinal"), taken.alias("taken"), used.alias("used_chars"))).alias("out")).cast(state)

    return lists.select("case_id", F.inline(F.aggregate("claims", start, step, lambda acc: acc["out"])))


def contract(answers: DataFrame) -> DataFrame:
    """answers (case_id, answer, claims array<struct<text, evidence_ids>>, allowed array<string>): reason, `validated`
    if cited ids are allowed, required ones cited, and each claim's text stands in a line that cites its ids."""
    plain = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "[。；; ]+$", "")
    body = lambda line: plain(F.regexp_replace(F.trim(F.regexp_replace(line, CITATION, "")), r"^(?:[-*+]\s+|\d+[.)]\s+)", ""))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    lines = F.split("answer", r"\r?\n")
    found = F.forall("claims", lambda c: F.exists(lines, lambda line: F.contains(body(line), plain(c["text"])) & inside(c["evidence_ids"], citations(line))))
    required = F.flatten(F.transform("claims", lambda c: c["evidence_ids"]))
    reason = (
        F.when((F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.size("claims") < 1) | (F.size("allowed") < 1), "empty_answer_contract")
        .when(~inside(citations(F.col("answer")), F.col("allowed")), "unapproved_citation")
        .when(~inside(required, citations(F.col("answer"))), "missing_required_citation")
        .when(~found, "claim_text_or_mapping_changed").otherwise("validated")
    )
    return answers.select("case_id", reason.alias("reason"))


def citation_numbers(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Numbers for citations in order of first sight: each key (path, line, symbol) has one. A registry covers one
    answer's citations, so its window is one answer's rows."""
    first = rows.groupBy("answer_id", *keys).agg(F.min(order).alias("_first"))
    numbered = first.withColumn("citation", F.row_number().over(Window.partitionBy("answer_id").orderBy("_first")))
    return rows.join(numbered.drop("_first"), ["answer_id", *keys])


def budget_prefix(parts: DataFrame, group: str, order: str, size: str, total: int, each: int) -> DataFrame:
    """Parts in order, each cut to `each` characters, as far as `total` goes; the last may be cut further."""
    cut = F.least(F.col(size), F.lit(each))
    before = F.coalesce(F.sum(cut).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("kept", F.greatest(F.lit(0), F.least(cut, F.lit(total) - before))).filter("kept > 0")


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Streamed tool calls (stream_id, seq, call_index, id, name, arguments): one row for each call with its pieces in order."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "arguments"))), lambda s: F.coalesce(s["arguments"], F.lit(""))), "")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return deltas.groupBy("stream_id", "call_index").agg(first("id").alias("id"), first("name").alias("name"), piece.alias("arguments"))
