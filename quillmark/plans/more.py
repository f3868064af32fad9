"""Further operators as queries: deletion with cascade, configuration search, merges of indexes, budgets, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, catalog, controller, evaluation, facts, scip
from quillmark.plans.registry import own, query, table

CITED = "SELECT conv_id AS answer_id, turn, role AS symbol, CAST(length(text) % 7 AS INTEGER) AS line FROM conversations"


@query(f"WITH r AS ({CITED}), f AS (SELECT answer_id, symbol, line, min(turn) AS first FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first) AS citation FROM f) SELECT r.answer_id, r.turn, r.symbol, r.line, n.citation FROM r JOIN n USING (answer_id, symbol, line)")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), "turn", F.col("role").alias("symbol"), (F.length("text") % 7).alias("line"))
    return controller.citation_numbers(rows, ["symbol", "line"], "turn").withColumn("citation", F.col("citation").cast("long"))


@query("""WITH c AS (SELECT conv_id, turn, least(length(text), 200) AS cut FROM conversations), b AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id, turn, CAST(greatest(0, least(cut, 600 - before)) AS BIGINT) AS kept FROM b WHERE least(cut, 600 - before) > 0""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return controller.budget_prefix(parts, "conv_id", "turn", "n", 600, 200).select("conv_id", "turn", F.col("kept").cast("long").alias("kept"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21) AND (c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING'))
SELECT 'projects' AS tab, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'files', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'symbols', count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey NOT IN (SELECT c_custkey FROM gone)""")
def delete_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, files, symbols = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    asked = projects.filter(F.col("c_custkey").isin(3, 5, 8, 13, 21) & ((F.col("c_nationkey") % 2 == 0) | (F.col("c_mktsegment") == "BUILDING"))).select("c_custkey")
    kept_files = catalog.without(files.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), asked, ["c_custkey"])
    kept_symbols = catalog.only(symbols.select(F.col("l_orderkey").alias("o_orderkey")), kept_files.select("o_orderkey"), ["o_orderkey"])
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tab"), "n")
    return count(catalog.without(projects, asked, ["c_custkey"]), "projects").union(count(kept_files, "files")).union(count(kept_symbols, "symbols"))


CONFIG = "SELECT CASE WHEN p_size % 2 = 0 THEN 'a/f' || p_size || '.yml' ELSE 'b/x' || p_size END AS path, CAST(p_partkey AS INTEGER) AS line, CASE p_size % 3 WHEN 0 THEN 'config_key' WHEN 1 THEN 'dependency' ELSE 'helm_value' END AS fact_type, p_brand AS key_path, 'db-' || p_type AS value, 'yaml' AS config_format FROM part UNION ALL SELECT * FROM (VALUES ('a/compose.yml', 3, 'compose_image', 'services.web.image', 'web:1', 'docker_compose'), ('a/compose.yml', 9, 'dependency', 'services.web', 'db', 'docker_compose'), ('b/values.yaml', 1, 'helm_value', 'image.tag', 'v1', 'helm_values'), ('b/x.yaml', 4, 'config_key', 'db.host', 'Database-1', 'yaml'), ('b/x.yaml', 5, 'config_key', 'port', '80', 'yaml')) AS t(path, line, fact_type, key_path, value, config_format)"


@query(f"""SELECT path, line, key_path, count(*) OVER () AS matches FROM ({CONFIG}) WHERE (contains(lower(path || ' ' || key_path || ' ' || value), 'db') OR contains(lower(path || ' ' || key_path || ' ' || value), 'database')) AND (starts_with(path, 'a/') OR starts_with(path, 'b/x')) AND fact_type IN ('config_key', 'dependency') ORDER BY path, line LIMIT 40 OFFSET 5""")
def config_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own(spark, sf_dir, CONFIG)
    hits = rows.filter(T.has_any(F.lower(F.concat_ws(" ", "path", "key_path", "value")), ["db", "database"]) & (F.startswith("path", F.lit("a/")) | F.startswith("path", F.lit("b/x"))) & F.col("fact_type").isin("config_key", "dependency"))
    total = hits.agg(F.count("*").alias("matches"))
    return access.page(hits.join(F.broadcast(total)).select("path", "line", "key_path", "matches"), ["path", "line"], 40, 5, 100)


@query("""SELECT count(*) AS n_queries, round(avg(precision_at_k), 4) AS precision_at_k, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(ndcg), 4) AS ndcg, round(avg(CAST(hit AS DOUBLE)), 4) AS hit_rate FROM (
 SELECT query_id, round(hits / 5.0::DOUBLE, 6) AS precision_at_k, hits > 0 AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM (
 SELECT query_id, count(*) FILTER (ok) AS hits, min(rank) FILTER (ok) AS first, sum(CASE WHEN ok THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM generate_series(1, 5) g(i) WHERE i <= (count(*) FILTER (ok))) AS ideal
 FROM (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority = '1-URGENT' AS ok FROM orders) WHERE rank <= 5 GROUP BY query_id))""")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), (F.col("o_orderpriority") == "1-URGENT").alias("hit"))
    return evaluation.summary(evaluation.ranked_metrics(rows, 5))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one line number the first in the file counts, as where a single thread reads it."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", *place)
    return facts.first_seen(rows, ["l_orderkey", "l_returnflag"], "l_linenumber", "_file", "_row").drop("l_returnflag", "_file", "_row")


URLS = "SELECT page_id + 10 AS id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/Own' || page_id || '/repo.' || page_id % 7 || '.git' WHEN 1 THEN ' https://github.com/a-b/c' || page_id || '/ ' WHEN 2 THEN url ELSE 'http://github.com/x/' || page_id END AS u FROM pages UNION ALL SELECT * FROM (VALUES (1, 'https://github.com/Own/repo.git'), (2, 'https://github.com/own/repo/'), (3, 'http://github.com/own/repo'), (4, 'https://github.com/own'), (5, 'https://evil.test/own/repo'), (6, ' https://github.com/a-b/c.d ')) AS t(id, u)"


@query(f"""WITH m AS (SELECT id, regexp_extract(trim(u), '^(?i)https://github\\.com/([A-Za-z0-9][A-Za-z0-9-]{{0,38}})/([A-Za-z0-9._-]+?)(?:\\.git)?/?$', 1) AS o, regexp_extract(trim(u), '^(?i)https://github\\.com/([A-Za-z0-9][A-Za-z0-9-]{{0,38}})/([A-Za-z0-9._-]+?)(?:\\.git)?/?$', 2) AS n FROM ({URLS}))
SELECT id, CASE WHEN o <> '' THEN 'https://github.com/' || o || '/' || n || '.git' END AS url, CASE WHEN o <> '' THEN lower(o || '/' || n) END AS repository_key FROM m""")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.repository_url(F.col("u"))
    return own(spark, sf_dir, URLS).select("id", r["url"].alias("url"), F.lower(F.concat(r["owner"], F.lit("/"), r["name"])).alias("repository_key"))


# line items are the symbols of three files, orders what an index says of them: every fourth defines, every fourth imports
SYMBOLS = "SELECT l_returnflag AS path, l_orderkey * 1000 + l_linenumber * 100 + ascii(l_returnflag) AS symbol_id, 'n' || l_linenumber AS name, 'function' AS kind, l_orderkey AS start_line, l_orderkey + CAST(max(l_quantity) AS BIGINT) AS end_line FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber"
INDEXED = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS path, 'pkg/n' || o_orderkey % 11 || '/' || o_custkey % 300 || '#' AS symbol, 'n' || o_orderkey % 11 AS name, o_custkey % 300 AS k, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS roles, o_orderkey AS place FROM orders"


@query(f"""WITH s AS ({SYMBOLS}), o AS (SELECT DISTINCT *, place + 1 AS line FROM ({INDEXED})), d AS (SELECT * FROM o WHERE roles = 1 AND k % 10 <> 0),
h AS (SELECT d.path, d.name, d.line, arg_min(s.symbol_id, (s.start_line, s.symbol_id)) AS symbol_id FROM d JOIN s ON s.path = d.path AND s.name = d.name AND d.line BETWEEN s.start_line AND s.end_line GROUP BY ALL),
n AS (SELECT DISTINCT d.path, d.name, d.line FROM d LEFT JOIN h USING (path, name, line) WHERE h.symbol_id IS NULL),
known AS (SELECT d.symbol, arg_max(coalesce(CAST(h.symbol_id AS VARCHAR), d.path || d.name || '@' || d.line), (d.path, d.line)) AS target FROM d LEFT JOIN h USING (path, name, line) GROUP BY d.symbol),
spans AS (SELECT path, CAST(symbol_id AS VARCHAR) AS said, start_line, end_line, symbol_id FROM s UNION ALL SELECT path, path || name || '@' || line, line, line + 60, 0 FROM n),
b AS (SELECT *, unnest(range(start_line // 32, end_line // 32 + 1)) AS bin FROM spans), u AS (SELECT DISTINCT path, symbol, line, roles FROM o WHERE roles <> 1),
near AS (SELECT p.path, p.line, arg_min(said, (end_line - start_line) * 1000000000000 - start_line * 1000 + symbol_id % 1000) AS source FROM (SELECT DISTINCT path, line FROM u) p JOIN b ON b.path = p.path AND b.bin = p.line // 32 AND p.line BETWEEN start_line AND end_line GROUP BY ALL)
SELECT DISTINCT coalesce(near.source, 'file ' || u.path) AS source, CASE WHEN roles = 2 THEN 'imports' ELSE 'references' END AS relation_type, known.target, u.symbol AS target_ref, u.line FROM u LEFT JOIN near USING (path, line) LEFT JOIN known USING (symbol)""")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and references of a code index joined with the symbols found in the sources."""
    key, nth = F.col("l_orderkey"), F.col("l_linenumber")
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("path"), key, nth).agg((key + F.max("l_quantity").cast("long")).alias("end_line"))
    found = found.select("path", (key * 1000 + nth * 100 + F.ascii("path")).alias("symbol_id"), F.concat(F.lit("n"), nth.cast("string")).alias("name"), F.lit("function").alias("kind"), key.alias("start_line"), "end_line")
    files = found.select("path").distinct().select("path", (-F.ascii("path")).cast("long").alias("symbol_id"), F.lit("file").alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"))
    at, k = F.col("o_orderkey"), F.col("o_custkey") % 300
    name = F.concat(F.lit("n"), (at % 11).cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        F.when(at % 3 == 0, "A").when(at % 3 == 1, "N").otherwise("R").alias("path"), F.concat(F.lit("pkg/"), name, F.lit("/"), k.cast("string"), F.lit("#")).alias("symbol"), name.alias("display_name"), F.when(k % 10 == 0, "variable").otherwise("method").alias("kind_name"),
        F.when(at % 4 == 0, 1).when(at % 4 == 1, 2).otherwise(0).alias("roles"), F.array(at, F.lit(0), F.lit(5)).cast("array<int>").alias("range"), F.array(at, F.lit(0), at + 60, F.lit(1)).cast("array<int>").alias("enclosing"),
    )
    infos = rows.select("symbol", "kind_name", "display_name", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("documentation")).distinct()
    occurrences, symbols = rows.select("path", "symbol", "roles", "range", "enclosing"), found.unionByName(files)
    added = scip.enriched(infos, occurrences, symbols).select(F.col("symbol_id").alias("_id"), F.concat("path", "qualified_name").alias("_said"))
    names = added.union(files.select("symbol_id", F.concat(F.lit("file "), "path")))
    said = lambda df, c, to: df.join(names, F.col(c) == F.col("_id"), "left").withColumn(to, F.coalesce("_said", F.col(c).cast("string"))).drop("_id", "_said")
    return said(said(scip.references(infos, occurrences, symbols), "source_id", "source"), "target_id", "target").select("source", "relation_type", "target", "target_ref", F.col("line").cast("long").alias("line"))
