"""Chunking and scalar text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking
from quillmark.plans.registry import own, query, table

URL_SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def windows_sql(size: int, overlap: int, source: str, key: str) -> str:
    """Recursive windows over source(key, t): key, chunk_index, content."""
    stop = f"CASE WHEN s + {size} >= n THEN n WHEN length(regexp_extract(substr(t, s + 1, {size}), '(?s)^(.*)[ \\n]', 1)) > {size // 2} THEN s + length(regexp_extract(substr(t, s + 1, {size}), '(?s)^(.*)[ \\n]', 1)) ELSE s + {size} END"
    return f"""
      SELECT {key}, k AS chunk_index, substr(t, s + 1, e - s) AS content FROM (
        WITH RECURSIVE base AS (SELECT {key}, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM ({source})),
        w AS (
          SELECT {key}, t, n, 0 AS k, s, {stop} AS e FROM (SELECT {key}, t, length(t) AS n, 0 AS s FROM base WHERE length(t) > 0)
          UNION ALL
          SELECT {key}, t, n, k, s, {stop} FROM (SELECT {key}, t, n, k + 1 AS k, greatest(e - {overlap}, s + 1) AS s FROM w WHERE e < n)
        ) SELECT * FROM w)"""


DOCS = "SELECT doc_id, text AS t FROM documents"


@query(f"SELECT doc_id, chunk_index, content, CAST(length(content) AS INTEGER) AS char_count FROM ({windows_sql(700, 100, DOCS, 'doc_id')})")
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_windows(table(spark, sf_dir, "documents"))


PARENTS = windows_sql(2400, 0, DOCS, "doc_id")
CHILDREN = windows_sql(700, 100, f"SELECT doc_id * 100000 + chunk_index AS pk, content AS t FROM ({PARENTS})", "pk")


@query(f"""SELECT doc_id, CAST(chunk_index AS INTEGER) AS parent_index, CAST(NULL AS INTEGER) AS child_index, 'parent' AS chunk_level, content, CAST(length(content) AS INTEGER) AS char_count FROM ({PARENTS})
UNION ALL SELECT pk // 100000, CAST(pk % 100000 AS INTEGER), chunk_index, 'child', content, CAST(length(content) AS INTEGER) FROM ({CHILDREN})""")
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_child(table(spark, sf_dir, "documents"))


@query(f"""SELECT d.lang, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(greatest(1, CAST(ceil(length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) / 2.0) AS BIGINT))) AS BIGINT) AS tokens
FROM ({windows_sql(700, 100, DOCS, 'doc_id')}) c JOIN documents d USING (doc_id) GROUP BY d.lang""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = chunking.exploded(docs, lambda text: [(w, "") for w in chunking.windows(text, 700, 100)], ["lang"], ["text"])
    return pieces.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(T.sha256(F.col("text")).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 2.0) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{URL_SPACE.replace('-', '')}') || encode('document:' || doc_id)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM h""")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(URL_SPACE, F.concat(F.lit("document:"), F.col("doc_id").cast("string"))).alias("uuid"))


SECRETS = """SELECT doc_id + 1000 AS id, CASE WHEN doc_id % 7 = 0 THEN 'api_key' ELSE source END AS name, text AS value FROM documents UNION ALL SELECT conv_id * 1000 + turn + 100000000, role, 'token: ' || conv_id || '; ' || text FROM conversations UNION ALL SELECT * FROM (VALUES
 (1, 'password', '"password=hunter2; host=db"'), (2, 'dsn', 'postgres://app:s3cret@db.local:5432/kb'), (3, 'url', 'https://x.test/a?token=abc123&page=2'),
 (4, 'api_key', 'plain'), (5, 'note', 'api-key: 12345, owner: ops'), (6, 'long', 'aaaaaaaaaabbbbbbbbbbccccccccccddddddddddeeeeeeeeeeffffffffffgggggggggghhhhhhhhhhiiiiiiiiiijjjjjjjjjjkkkkkkkkkkllllllllllmmmmmmmmmmnnnnnnnnnnooooooooooppppppppppqqqqqqqqqqrrrrrrrrrrssssssssssttttttttttt'), (7, 'empty', '')
) AS t(id, name, value)"""


@query(f"""WITH c AS (SELECT id, name, value, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '^["''`]+|["''`]+$', '', 'g'),
 '(?i)(password|passwd|pwd|token|secret|api[_-]?key)\\s*[:=]\\s*([^;,&\\s]+)', '\\1=[REDACTED]', 'g'), '(?i)(://[^:/\\s]+:)[^@/\\s]+@', '\\1[REDACTED]@', 'g'), '(?i)([?&](?:token|key|signature|sig|credential)=)[^&#\\s]+', '\\1[REDACTED]', 'g') AS clean FROM ({SECRETS}))
SELECT id, CASE WHEN length(clean) > 180 THEN substr(clean, 1, 177) || '...' ELSE clean END AS safe, CASE WHEN regexp_matches(name, '(?i)(password|passwd|pwd|token|secret|api[_-]?key|credential)') THEN '[REDACTED]' ELSE substr(trim(value), 1, 500) END AS named FROM c""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, SECRETS).select("id", T.redact(F.col("value")).alias("safe"), T.redact_named(F.col("name"), F.col("value")).alias("named"))


QUESTIONS = """SELECT conv_id * 1000 + turn + 100 AS id, CASE conv_id % 4 WHEN 0 THEN 'topic ' WHEN 1 THEN 'SOP ' ELSE '' END || text AS q FROM conversations UNION ALL SELECT doc_id + 100000000, text FROM documents UNION ALL SELECT * FROM (VALUES (1, '这个项目是否符合规范'), (2, '报销流程是什么'), (3, '订单服务的依赖'), (4, 'hello world'), (5, 'SOP for Kafka topic'), (6, '为什么 redis 慢'), (7, 'topic owners'), (8, '架构')) AS t(id, q)"""


def any_sql(words: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"SELECT id, CASE WHEN {any_sql(T.BOTH_WORDS, 'q')} AND {any_sql(T.BOTH_TARGETS, 'lower(q)')} THEN 'hybrid' WHEN {any_sql(T.DOCUMENT_WORDS, 'lower(q)')} THEN 'rag' WHEN {any_sql(T.CODE_WORDS, 'lower(q)')} THEN 'wiki' ELSE 'hybrid' END AS route FROM ({QUESTIONS})")
def route_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, QUESTIONS).select("id", T.route(F.col("q")).alias("route"))


TERM_SOURCE = "SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES (100001, '知识库检索 how to use Kafka_topic'), (100002, 'a b 流程'), (100003, '')) AS t(item_id, text)"


@query(f"""WITH s AS ({TERM_SOURCE}), tok AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]+')) AS t FROM s),
terms AS (SELECT item_id, lower(t) AS term FROM tok WHERE NOT regexp_matches(t, '^[一-鿿]') AND length(t) >= 2
  UNION SELECT item_id, t FROM tok WHERE regexp_matches(t, '^[一-鿿]')
  UNION SELECT item_id, substr(t, CAST(i AS INTEGER), CAST(w AS INTEGER)) FROM tok, (VALUES (2), (3), (4)) AS x(w), generate_series(1, 200) AS g(i) WHERE regexp_matches(t, '^[一-鿿]') AND i <= length(t) - w + 1),
ranked AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS r FROM terms)
SELECT s.item_id, coalesce(string_agg(term, '|' ORDER BY r) FILTER (r <= 80), '') AS terms FROM s LEFT JOIN ranked USING (item_id) GROUP BY s.item_id""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").union(spark.createDataFrame([(100001, "知识库检索 how to use Kafka_topic"), (100002, "a b 流程"), (100003, "")], "item_id long, text string"))
    return items.select("item_id", F.array_join(T.keyword_terms(F.col("text")), "|").alias("terms"))


MARKDOWN = """# Guide

Intro words.

## Table ##
| name | size |
| --- | --- |
| a | 1 |
| b | 2 | extra |

```
# not a heading
```
# Next
tail"""


TITLED = "SELECT p_partkey AS doc_id, '# Title ' || p_partkey || chr(10) || chr(10) || 'Body: ' || p_type || ' end' || chr(10) || chr(10) || '## Part ' || p_size || ' ##' || chr(10) || chr(10) || 'More of ' || p_name || '.' || chr(10) AS text FROM part"


@query("""SELECT p_partkey AS doc_id, 0 AS chunk_index, 'Title ' || p_partkey AS ref, '# Title ' || p_partkey || chr(10) || chr(10) || 'Body: ' || p_type || ' end' AS content FROM part
UNION ALL SELECT p_partkey, 1, 'Title ' || p_partkey || ' > Part ' || p_size, '## Part ' || p_size || ' ##' || chr(10) || chr(10) || 'More of ' || p_name || '.' FROM part""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.exploded(own(spark, sf_dir, TITLED), chunking.markdown, ["doc_id"], ["text"])


SOURCES = [
    ("a/app.py", "import os\nfrom x import y as z\nLIMIT = 3\n\nclass Box:\n    size = 1\n\n    def get(self):\n        return helper(os.path.join('a'))\n\ndef helper(p):\n    return p\n\nprint(LIMIT)\n"),
    ("a/main.go", "package main\n\nfunc main() {\n\trun()\n}\n\nfunc (s *S) run() {\n}\n"),
    ("a/ui.ts", "import x from 'y';\nexport class View {}\nexport async function draw() {}\n"),
    ("a/broken.py", "def f(:\n"),
]


SCRIPTS = "SELECT 'src/m' || p_partkey || '.py' AS path, 'import m' || p_size || chr(10) || chr(10) || chr(10) || 'def f' || p_partkey || '(a):' || chr(10) || '    return a' || chr(10) || chr(10) || chr(10) || 'def g' || p_size || '(a):' || chr(10) || '    return f' || p_partkey || '(a)' || chr(10) AS text, 'py' AS suffix FROM part"


@query()
def code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.exploded(own(spark, sf_dir, SCRIPTS), chunking.by_suffix, ["path"], ["text", "suffix"])

