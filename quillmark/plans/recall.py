"""Vector and keyword recall, fusion, context and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, evaluation, providers, retrieval, similar
from quillmark.plans.chunks import CHILDREN, PARENTS
from quillmark.plans.registry import own, query, table


def first_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    return vectors.filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors, first_vector(vectors, 0), 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label % 2 = 0 AND e.embedding IS NOT NULL ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors.filter("label % 2 = 0 and embedding is not null"), first_vector(vectors, 1), 20).select("vec_id", F.round("score", 6).alias("score"))


def batch(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.nearest_each(vectors, queries, k)


BATCH = f"SELECT q.vec_id AS query_id, e.vec_id, e.label AS label, q.label AS query_label, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({BATCH}) WHERE rank <= 10")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def grams_sql(c: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similar_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0))"


@query(f"""WITH b AS (SELECT item_id, {grams_sql('text')} AS g FROM benchmark), t AS (SELECT term, {grams_sql('term')} AS h FROM (VALUES ('thention'), ('onesen the'), ('blend')) AS x(term))
SELECT item_id, term, round({similar_sql('g', 'h')}, 6) AS similarity FROM b, t""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.explode(F.array(*map(F.lit, ["thention", "onesen the", "blend"])))
    own = table(spark, sf_dir, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("g"), terms.alias("term"))
    return own.select("item_id", "term", F.round(T.similarity(F.col("g"), T.trigrams(F.col("term"))), 6).alias("similarity"))


TERMS = ["thention the", "und der", "anche", "ciónar"]


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), d AS (SELECT doc_id * 100000 + i AS line_id, {grams_sql('content')} AS g FROM l),
t AS (SELECT {grams_sql('term')} AS h FROM (VALUES {', '.join(f"('{t}')" for t in TERMS)}) AS x(term)), s AS (SELECT line_id, max({similar_sql('g', 'h')}) AS score FROM d, t GROUP BY line_id)
SELECT line_id, round(score, 6) AS keyword_score FROM s WHERE score >= 0.3 ORDER BY score DESC, line_id LIMIT 50""")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document against the query's terms; the 50 best."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    rows = lines.select((F.col("doc_id") * 100_000 + F.col("i") + 1).alias("line_id"), "content")
    return retrieval.keyword_recall(rows, TERMS, 50, "line_id").select("line_id", F.round("keyword_score", 6).alias("keyword_score"))


RANKINGS = """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200),
b AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(text), doc_id) AS rank FROM documents QUALIFY rank <= 200),
f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fused_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)"""


def top_ranked(docs: DataFrame, order: list, k: int) -> DataFrame:
    """The k first in a total order with their ranks: top-k first, then ranks over those few rows alone."""
    return docs.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def two_rankings(docs: DataFrame) -> list[DataFrame]:
    own = docs.select("doc_id", F.length("text").alias("n"), T.sha256(F.col("text")).alias("h"))
    return [top_ranked(own, [F.desc("n"), F.asc("doc_id")], 200), top_ranked(own, [F.asc("h"), F.asc("doc_id")], 200)]


@query(RANKINGS + " SELECT doc_id, round(fused_score, 9) AS fused_score FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(two_rankings(table(spark, sf_dir, "documents")), "doc_id").select("doc_id", F.round("fused_score", 9).alias("fused_score"))


@query(RANKINGS + """, n AS (SELECT f.doc_id, d.source, round(fused_score, 9) AS fused_score, row_number() OVER (PARTITION BY d.source ORDER BY round(fused_score, 9) DESC, f.doc_id) AS nth FROM f JOIN documents d USING (doc_id))
SELECT doc_id, source, fused_score FROM n WHERE nth <= 3 ORDER BY fused_score DESC, doc_id LIMIT 20""")
def rrf_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fused = retrieval.fuse(two_rankings(docs), "doc_id").withColumn("fused_score", F.round("fused_score", 9)).join(docs.select("doc_id", "source"), "doc_id")
    return retrieval.diversify(fused, "source", "doc_id", 20).select("doc_id", "source", "fused_score")


SCOPED = "SELECT *, CASE doc_id % 3 WHEN 0 THEN 'workspace' WHEN 1 THEN 'personal' ELSE 'department' END AS scope_type, CASE WHEN doc_id % 3 = 1 THEN 'u' || doc_id % 5 END AS owner_user_id, CASE WHEN doc_id % 3 = 2 THEN 'd' || doc_id % 4 END AS owner_department_id FROM documents"


def scoped(docs: DataFrame) -> DataFrame:
    scope = F.element_at(F.array(F.lit("workspace"), F.lit("personal"), F.lit("department")), (F.col("doc_id") % 3 + 1).cast("int"))
    named = lambda p, n: F.concat(F.lit(p), (F.col("doc_id") % n).cast("string"))
    return docs.withColumn("scope_type", scope).withColumn("owner_user_id", F.when(F.col("doc_id") % 3 == 1, named("u", 5))).withColumn("owner_department_id", F.when(F.col("doc_id") % 3 == 2, named("d", 4)))


@query(f"SELECT doc_id, scope_type FROM ({SCOPED}) WHERE scope_type = 'workspace' OR (scope_type = 'personal' AND owner_user_id = 'u2') OR (scope_type = 'department' AND owner_department_id = 'd1')")
def visibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(table(spark, sf_dir, "documents")).filter(retrieval.visible("u2", "d1")).select("doc_id", "scope_type")


PIECES = f"SELECT doc_id * 1000000 + chunk_index * 1000 AS chunk_id, doc_id, content FROM ({PARENTS})"
KIDS = f"SELECT (pk // 100000) * 1000000 + (pk % 100000) * 1000 + chunk_index + 1 AS chunk_id, (pk // 100000) * 1000000 + (pk % 100000) * 1000 AS parent_chunk_id, pk // 100000 AS doc_id, content FROM ({CHILDREN})"
ASKED_FOR = ["of", "that", "the", "und", "les", "los"]
TOKENS = "greatest(1, CAST(ceil(length(regexp_replace({}, '^\\s+|\\s+$', '', 'g')) / 2.0) AS BIGINT))"


@query(f"""WITH RECURSIVE k AS (SELECT doc_id % 20 AS query_id, chunk_id, parent_chunk_id, content, len(list_intersect(list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x))), {ASKED_FOR!r})) AS score FROM ({KIDS})),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k QUALIFY rank <= 20),
f AS (SELECT h.*, p.content AS parent FROM h LEFT JOIN ({PIECES}) p ON p.chunk_id = h.parent_chunk_id QUALIFY row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY rank) = 1),
o AS (SELECT query_id, rank, chunk_id, coalesce(parent, content) AS text, content AS child, parent IS NOT NULL AS whole, {TOKENS.format('coalesce(parent, content)')} AS n, {TOKENS.format('content')} AS c, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM f),
w AS (SELECT query_id, 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS rank, 0::BIGINT AS chunk_id, '' AS context_level, '' AS content, 0::BIGINT AS context_tokens FROM (SELECT DISTINCT query_id FROM o)
 UNION ALL SELECT o.query_id, o.r, w.used + CASE WHEN o.n <= 6000 - w.used THEN o.n WHEN o.c <= 6000 - w.used THEN o.c ELSE {TOKENS.format('substr(o.child, 1, greatest(2, (6000 - w.used) * 2))')} END, o.rank, o.chunk_id,
  CASE WHEN o.n <= 6000 - w.used THEN CASE WHEN o.whole THEN 'parent' ELSE 'child' END WHEN o.c <= 6000 - w.used THEN 'child_fallback' ELSE 'child_truncated' END,
  CASE WHEN o.n <= 6000 - w.used THEN o.text WHEN o.c <= 6000 - w.used THEN o.child ELSE substr(o.child, 1, greatest(2, (6000 - w.used) * 2)) END,
  CASE WHEN o.n <= 6000 - w.used THEN o.n WHEN o.c <= 6000 - w.used THEN o.c ELSE {TOKENS.format('substr(o.child, 1, greatest(2, (6000 - w.used) * 2))')} END FROM w JOIN o ON o.query_id = w.query_id AND o.r = w.r + 1 WHERE w.used < 6000)
SELECT query_id, rank, chunk_id, context_level, content, context_tokens FROM w WHERE r > 0""")
def context_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 children of each query that share most words with it, out of all, as context under a budget."""
    pieces = chunking.parent_child(table(spark, sf_dir, "documents"))
    pid = F.col("doc_id") * 1_000_000 + F.col("parent_index") * 1_000
    parents = pieces.filter("chunk_level = 'parent'").select(pid.alias("chunk_id"), "content")
    children = pieces.filter("chunk_level = 'child'").select((F.col("doc_id") % 20).alias("query_id"), (pid + F.col("child_index") + 1).alias("chunk_id"), pid.alias("parent_chunk_id"), "content")
    score = providers.lexical(F.col("content"), F.array(*map(F.lit, ASKED_FOR)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    return retrieval.expand(children.withColumn("rank", rank).filter("rank <= 20"), parents, 6000)


@query("""SELECT query_id, round(hits / 5.0::DOUBLE, 6) AS precision_at_k, hits > 0 AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM (
 SELECT query_id, count(*) FILTER (ok) AS hits, min(rank) FILTER (ok) AS first, sum(CASE WHEN ok THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg,
  (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM generate_series(1, 5) g(i) WHERE i <= (count(*) FILTER (ok))) AS ideal
 FROM (SELECT *, label = query_label AS ok FROM (""" + BATCH + ") WHERE rank <= 5) GROUP BY query_id)")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = batch(spark, sf_dir, 5).join(labels, "vec_id").join(F.broadcast(labels.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))), "query_id")
    return evaluation.ranked_metrics(found.withColumn("hit", F.col("label") == F.col("wanted")), 5)


ANSWERS = """SELECT conv_id * 1000 + turn + 10 AS case_id, text || ' [' || turn % 4 || ']' || CASE WHEN conv_id % 9 = 0 THEN ' 未找到' ELSE '' END AS answer, CASE WHEN turn % 2 = 0 THEN 'the|ein|que' ELSE '' END AS terms, 'use|assi' AS source_terms, role || '|' || CASE WHEN conv_id % 2 = 0 THEN 'user' ELSE 'none' END AS sources, conv_id % 9 = 0 AS should_refuse FROM conversations
 UNION ALL SELECT * FROM (VALUES
 (1, 'Kafka topics are owned by ops [1] and [2].', 'kafka|owned', 'ops-guide', 'ops-guide kafka|other text', false),
 (2, '证据不足，无法回答。', 'x', 'y', 'y', true), (3, 'Nothing cited here', 'nothing|missing', 'a', 'a', false), (4, 'Wrong [9] and right [1]', '', 'zebra', 'a zebra', false)
) AS t(case_id, answer, terms, source_terms, sources, should_refuse)"""


@query(f"""WITH a AS (SELECT case_id, answer, string_split(source_terms, '|') AS st, string_split(sources, '|') AS ss, CASE WHEN terms = '' THEN [] ELSE string_split(terms, '|') END AS ts, should_refuse,
 list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER))) AS cited, regexp_matches(answer, '无法确认|证据不足|没有相关|未找到|不能确定|无法回答') AS refused FROM ({ANSWERS}))
SELECT case_id, round(CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda t: contains(lower(answer), t))) / len(ts) WHEN should_refuse THEN 0 ELSE 1 END, 6) AS term_coverage, len(cited) > 0 AS citation_present,
 len(list_filter(cited, lambda i: i >= 1 AND i <= len(ss) AND len(list_filter(st, lambda t: contains(lower(ss[i]), t))) > 0)) > 0 AS citation_correct, refused AS refusal_detected, refused = should_refuse AS refusal_correct FROM a""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]"))
    return evaluation.answer_metrics(own(spark, sf_dir, ANSWERS).withColumns({c: parts(c) for c in ("terms", "source_terms", "sources")}))


@query("""SELECT conv_id, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t / 1000.0::DOUBLE * p), 8) AS cost FROM (SELECT conv_id, CAST(ceil(length(text) / 2.0) AS BIGINT) AS t, CASE role WHEN 'assistant' THEN 0.006::DOUBLE WHEN 'system' THEN 0.001::DOUBLE ELSE 0.002::DOUBLE END AS p FROM conversations) GROUP BY conv_id""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("meter"), F.ceil(F.length("text") / 2.0).alias("tokens"))
    return evaluation.cost(usage, {"assistant": 0.006, "system": 0.001, "user": 0.002}, "conv_id")


@query("""WITH h AS (SELECT doc_id % 10 AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS rank, text FROM documents),
s AS (SELECT query_id, chunk_id, rank, CAST(len(list_intersect(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda x: lower(x))), ['of', 'that', 'the', 'with'])) AS DOUBLE) AS rerank_score FROM h)
SELECT * FROM (SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS new_rank FROM s) WHERE new_rank <= 5""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    hits = docs.select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")).withColumn("rank", rank)
    score = providers.lexical(F.col("content"), F.array(*map(F.lit, ["of", "that", "the", "with"]))).cast("double")
    return providers.reranked(hits, "with the of that", 5, score).select("query_id", "chunk_id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank"))


ASKS = "SELECT conv_id * 1000 + turn + 10 AS id, text AS q FROM conversations UNION ALL SELECT * FROM (VALUES (1, 'how do the teams rotate their signing keys in production every year or so then?'), (2, 'rotate keys'), (3, 'a b'), (4, 'one two three')) AS t(id, q)"


@query(f"""WITH w AS (SELECT id, q, list_filter(regexp_split_to_array(trim(regexp_replace(q, '[^\\pL\\pN_\\s]+', ' ', 'g')), '\\s+'), lambda x: length(x) > 1) AS ws FROM ({ASKS})),
c AS (SELECT id, q, [array_to_string(ws[1:12], ' '), array_to_string(ws[1:greatest(len(ws) - 1, 0)], ' '), array_to_string(ws[2:], ' '), array_to_string(ws[greatest(len(ws) - 7, 1):], ' ')] AS tries FROM w)
SELECT id, coalesce(list_filter(tries, lambda t: t <> '' AND lower(t) <> lower(q))[1], '') AS first_rewrite, len(list_distinct(list_filter(tries, lambda t: t <> '' AND lower(t) <> lower(q)))) AS n_rewrites FROM c""")
def query_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = retrieval.rewrites(F.col("q"))
    return own(spark, sf_dir, ASKS).select("id", F.coalesce(F.get(tries, F.lit(0)), F.lit("")).alias("first_rewrite"), F.size(tries).cast("long").alias("n_rewrites"))


LINED = "SELECT doc_id * 100000 + i AS line_id, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark), t AS (SELECT term, list_distinct({grams_sql('term')}) AS h FROM w), l AS (SELECT line_id, list_distinct({grams_sql('content')}) AS g FROM ({LINED}))
SELECT term, line_id, round({similar_sql('g', 'h')}, 6) AS similarity FROM l JOIN t ON len(g) <= len(h) / 0.3 AND len(h) <= len(g) / 0.3 WHERE len(g) > 0 AND len(h) > 0 AND {similar_sql('g', 'h')} >= 0.3""")
def term_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark with the lines of all documents that are like it."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    lines = lines.select((F.col("doc_id") * 100_000 + F.col("i") + 1).alias("line_id"), "content")
    return similar.similar(words, lines, 0.3, ("term", "line_id"), ("term", "content")).withColumn("similarity", F.round("similarity", 6))
