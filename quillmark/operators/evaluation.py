"""Retrieval and answer metrics over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import route


def relevant(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(text), t))


def ranked_metrics(results: DataFrame, k: int) -> DataFrame:
    """results (query_id, rank from 1, hit boolean): precision (over k, whatever was found), hit, reciprocal rank and
    nDCG, whose ideal is made of the hits retrieved."""
    top = results.filter(F.col("rank") <= k)
    gain = F.when(F.col("hit"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    hits = F.count_if("hit")
    per = top.groupBy("query_id").agg(hits.alias("hits"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), F.col("hits").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    r = lambda c: F.round(c, 6)
    return per.select("query_id", r(F.col("hits") / F.lit(float(k))).alias("precision_at_k"), (F.col("hits") > 0).alias("hit"), r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), r(F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0))).alias("ndcg"))


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision_at_k", "reciprocal_rank", "ndcg")], F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


def coverage(text: Column, terms: Column) -> Column:
    """Share of the terms that the text contains; 1 without terms."""
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))).cast("double"), F.size(terms).cast("double")), F.lit(1.0))


# Fixed value: how answers refuse.
REFUSAL = "无法确认|证据不足|没有相关|未找到|不能确定|无法回答"


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers (case_id, answer, terms, source_terms, sources array<string>, should_refuse): coverage of terms, presence
    and correctness of numbered citations, refusal."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    known = F.filter(cited, lambda i: (i >= 1) & (i <= F.size("sources")))
    right = F.exists(known, lambda i: F.exists("source_terms", lambda t: F.contains(F.lower(F.element_at(F.col("sources"), i)), t)))
    refused = F.col("answer").rlike(REFUSAL)
    covered = F.when(F.size("terms") > 0, coverage(F.col("answer"), F.col("terms"))).otherwise(F.when(F.col("should_refuse"), 0.0).otherwise(1.0))
    return answers.select("case_id", F.round(covered, 6).alias("term_coverage"), (F.size(cited) > 0).alias("citation_present"), right.alias("citation_correct"), refused.alias("refusal_detected"), (refused == F.col("should_refuse")).alias("refusal_correct"))


def cost(usage: DataFrame, prices: dict[str, float], key: str) -> DataFrame:
    """usage (key, meter, tokens): the cost at a price for each thousand tokens of a meter, rounded to eight places."""
    price = F.element_at(F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(v))]), F.col("meter"))
    return usage.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") / 1000.0 * price), 8).alias("cost"))


def source_recall(contexts: DataFrame, cases: DataFrame, parents_only: bool = False) -> DataFrame:
    """contexts (case_id, source_text, context_level), cases (case_id, terms array<string>): the share of a case's expected
    source terms that some of its contexts has, of those that are parents if asked; 0 without terms or contexts."""
    rows = contexts.filter("context_level = 'parent'") if parents_only else contexts
    hits = rows.join(cases.select("case_id", F.explode(F.array_distinct("terms")).alias("term")), "case_id").filter(F.contains(F.lower("source_text"), F.lower("term")))
    found = hits.groupBy("case_id").agg(F.count_distinct("term").alias("n"))
    share = F.coalesce(F.try_divide(F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.size(F.array_distinct("terms")).cast("double")), F.lit(0.0))
    return cases.join(found, "case_id", "left").select("case_id", F.round(share, 6).alias("recall"))


def case_report(cases: DataFrame, results: DataFrame, contexts: DataFrame, available: DataFrame, k: int) -> DataFrame:
    """One row for each case (case_id, question, expected_route, source_terms, required_terms): route and whether it is
    right, whether a source is there at all, rank metrics of its results (case_id, rank, source_text) up to k, coverage of
    required terms and recall by its contexts (case_id, source_text, context_level, context_tokens), their tokens and the
    number of parents. available (source_name): the sources in the store."""
    terms = cases.select("case_id", F.transform("source_terms", lambda t: F.lower(t)).alias("terms"))
    judged = results.join(terms, "case_id").select(F.col("case_id").alias("query_id"), "rank", relevant(F.col("source_text"), F.col("terms")).alias("hit"))
    ranked = ranked_metrics(judged, k).withColumnRenamed("query_id", "case_id")
    there = cases.select("case_id", F.explode("source_terms").alias("t")).select("case_id", F.lower("t").alias("t"))
    names = available.agg(F.array_join(F.sort_array(F.collect_set(F.lower("source_name"))), "\n").alias("names"))
    there = there.join(F.broadcast(names)).groupBy("case_id").agg(F.bool_or(F.contains("names", F.col("t"))).alias("source_available"))
    text = contexts.groupBy("case_id").agg(F.array_join(F.collect_list(F.lower("source_text")), " ").alias("_text"), F.count_if(F.col("context_level") == "parent").alias("parent_context_count"), F.sum("context_tokens").alias("context_tokens"))
    recalled = lambda parents, name: source_recall(contexts, terms, parents).withColumnRenamed("recall", name)
    rows = cases.join(ranked, "case_id", "left").join(there, "case_id", "left").join(text, "case_id", "left").join(recalled(False, "context_recall"), "case_id").join(recalled(True, "parent_context_recall"), "case_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    covered = coverage(F.coalesce("_text", F.lit("")), F.transform("required_terms", lambda t: F.lower(t)))
    return rows.select(
        "case_id", route(F.col("question")).alias("route"), (route(F.col("question")) == F.col("expected_route")).alias("route_correct"), F.coalesce("source_available", F.lit(False)).alias("source_available"), F.coalesce("hit", F.lit(False)).alias("source_hit"),
        zero("reciprocal_rank"), zero("precision_at_k"), zero("ndcg"), F.round(covered, 6).alias("required_term_coverage"), "context_recall", "parent_context_recall", zero("parent_context_count"), zero("context_tokens"),
    )
