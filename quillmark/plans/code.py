"""Code fact and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import access, architecture, facts, graph
from quillmark.functions import text as T
from quillmark.plans.registry import own, query, table

# every line item is a symbol over as many lines as its quantity, and a place that asks for the symbol around it
INTERVALS = "SELECT l_returnflag AS path, l_orderkey * 1000 + l_linenumber * 100 + ascii(l_returnflag) AS symbol_id, l_orderkey AS start_line, l_orderkey + CAST(max(l_quantity) AS BIGINT) AS end_line, l_orderkey + l_linenumber * 3 AS line FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber"


@query(f"""WITH s AS ({INTERVALS}), b AS (SELECT *, unnest(range(start_line // 32, end_line // 32 + 1)) AS bin FROM s)
SELECT p.symbol_id AS point_id, p.line, arg_min(b.symbol_id, (b.end_line - b.start_line) * 1000000000000 - b.start_line * 1000 + b.symbol_id % 1000) AS symbol_id FROM s p LEFT JOIN b ON b.path = p.path AND b.bin = p.line // 32 AND p.line BETWEEN b.start_line AND b.end_line GROUP BY p.symbol_id, p.line""")
def interval_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, nth = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("path"), at, nth).agg((at + F.max("l_quantity").cast("long")).alias("end_line"))
    rows = rows.select("path", (at * 1000 + nth * 100 + F.ascii("path")).alias("symbol_id"), at.alias("start_line"), "end_line", (at + nth * 3).alias("line"))
    points = rows.select("path", F.col("symbol_id").alias("point_id"), "line")
    return facts.innermost(points, rows.drop("line"), ["path"]).select("point_id", "line", "symbol_id")


FACTS = """SELECT k * 100 + n AS fact_id, CASE n WHEN 1 THEN 'client_initialization' WHEN 2 THEN 'downstream_call' WHEN 3 THEN 'endpoint_config' WHEN 4 THEN 'kafka_topic_config' WHEN 5 THEN 'kafka_topic_producer' WHEN 6 THEN 'kafka_topic_consumer' ELSE 'mongo_collection' END AS fact_type,
 CASE n WHEN 1 THEN 'Svc' || p || 'ServiceClient' WHEN 3 THEN 'SVC' || p || '_SERVICE_ADDR' ELSE 't' || p END AS name, CASE WHEN n < 3 THEN 'v' || k % 2 ELSE 'T' || p END AS value, CASE WHEN n IN (3, 4) OR (n = 7 AND k % 2 = 0) THEN 'deploy/f' || k || '.yaml' ELSE 'src/f' || k || '.py' END AS path
 FROM (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber) UNION ALL SELECT * FROM (VALUES
 (1, 'client_initialization', 'CartServiceClient', 'cart', 'src/app.py'), (2, 'downstream_call', 'GetCart', 'cart', 'src/app.py'), (3, 'downstream_call', 'GetCart', 'cart', 'src/b.py'),
 (4, 'endpoint_config', 'CART_SERVICE_ADDR', 'cart:70', 'deploy/values.yaml'), (5, 'endpoint_config', 'cart_addr', 'cart:70', 'deploy/compose.yml'), (6, 'kafka_topic_config', 'orders', 'orders', 'conf/app.yaml'),
 (7, 'kafka_topic_producer', 'orders', 'Orders', 'src/p.go'), (8, 'kafka_topic_consumer', 'orders', 'orders', 'src/c.go'), (9, 'mongo_collection', 'carts', 'carts', 'conf/app.yaml'), (10, 'mongo_collection', 'carts', 'carts', 'src/m.py'), (11, 'downstream_grpc', 'grpc-cart', 'cart:70', '.env.local')
) AS t(fact_id, fact_type, name, value, path)"""

IDENTITY = r"""regexp_replace(CASE WHEN fact_type = 'endpoint_config' THEN regexp_replace(raw, '^(.+?)(endpoint|target|address|addr|host|port)$', '\1') ELSE raw END, '^(.+?)(serviceclient|servicestub|service|client|stub)$', '\1')"""


@query(rf"""WITH f AS (SELECT *, regexp_matches(lower(path), '\.(yaml|yml|json|toml|ini|cfg|conf|properties)$') OR starts_with(lower(regexp_extract(path, '[^/]*$')), '.env') AS config, lower(trim(value)) AS resource,
 CASE WHEN fact_type IN ('downstream_grpc', 'client_initialization') THEN replace(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'grpc', '') ELSE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') END AS raw FROM ({FACTS})), g AS (SELECT *, {IDENTITY} AS identity FROM f)
SELECT a.fact_id AS source_id, b.fact_id AS target_id, 'client_invokes' AS relation_type, 0.96::DOUBLE AS confidence FROM g a JOIN g b ON a.fact_type = 'client_initialization' AND b.fact_type = 'downstream_call' AND a.path = b.path AND a.value = b.value
UNION SELECT a.fact_id, b.fact_id, 'configures_client', 0.9 FROM g a JOIN g b ON a.fact_type IN ('downstream_grpc', 'endpoint_config') AND a.config AND b.fact_type = 'client_initialization' AND a.identity = b.identity AND b.identity <> ''
UNION SELECT a.fact_id, b.fact_id, 'configures_usage', 0.98 FROM g a JOIN g b ON a.config AND NOT b.config AND a.resource = b.resource AND ((a.fact_type = 'kafka_topic_config' AND b.fact_type IN ('kafka_topic_producer', 'kafka_topic_consumer')) OR (a.fact_type = 'mongo_collection' AND b.fact_type = 'mongo_collection'))""")
def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.links(own(spark, sf_dir, FACTS, {"lineitem": ["l_orderkey", "l_linenumber"]}))


SYMBOLS = "SELECT p_partkey + 100 AS symbol_id, 'f' || p_size || '::' || p_brand AS \"key\", p_brand AS name, p_type AS qualified_name, p_partkey + 100 AS ordinal FROM part UNION ALL SELECT * FROM (VALUES (1, 'a.py::run', 'run', 'run', 0), (2, 'b.py::run', 'run', 'run', 1), (3, 'b.py::Box.get', 'get', 'Box.get', 2), (4, 'c.py::get', 'get', 'get', 3), (5, 'c.py::get', 'get', 'get', 4)) AS t(symbol_id, \"key\", name, qualified_name, ordinal)"
CALLS = "SELECT o.o_orderkey + 100 AS relation_id, CASE WHEN o.o_orderkey % 3 = 0 THEN 'f' || p.p_size || '::' || p.p_brand END AS target_key, CASE o.o_orderkey % 4 WHEN 0 THEN p.p_brand WHEN 1 THEN p.p_type WHEN 2 THEN 'missing' ELSE p.p_name END AS target_ref FROM orders o JOIN part p ON p.p_partkey = o.o_custkey UNION ALL SELECT * FROM (VALUES (1, 'b.py::run', 'run'), (2, NULL, 'run'), (3, NULL, 'Box.get'), (4, NULL, 'missing'), (5, 'c.py::get', 'x'), (6, 'gone', 'get')) AS t(relation_id, target_key, target_ref)"


@query(f"""WITH s AS ({SYMBOLS}), r AS ({CALLS}) SELECT relation_id, coalesce((SELECT arg_max(symbol_id, ordinal) FROM s WHERE s."key" = r.target_key), (SELECT arg_min(symbol_id, ordinal) FROM s WHERE s.name = r.target_ref), (SELECT arg_min(symbol_id, ordinal) FROM s WHERE s.qualified_name = r.target_ref)) AS target_id FROM r""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.resolve(own(spark, sf_dir, CALLS), own(spark, sf_dir, SYMBOLS.replace('"', "`"))).select("relation_id", "target_id")


PROJECT_FILES = "SELECT source, '/p/' || doc_id AS path, CASE doc_id % 6 WHEN 0 THEN 'app = FastAPI()' WHEN 1 THEN 'import psycopg' WHEN 2 THEN 'select vector(3)' ELSE text END AS content FROM documents"


@query(f"""WITH f AS ({PROJECT_FILES}), r AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{c}', '(?i)({'|'.join(p)})')" for n, c, p in facts.COMPONENTS)}) AS t(name, category, rule))
SELECT source, name, category, round(least(0.99::DOUBLE, 0.65::DOUBLE + 0.1::DOUBLE * count(*)), 6) AS confidence, count(*) AS n_files FROM f, r WHERE regexp_matches(content, rule) GROUP BY source, name, category""")
def component_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    content = F.when(kind == 0, "app = FastAPI()").when(kind == 1, "import psycopg").when(kind == 2, "select vector(3)").otherwise(F.col("text"))
    return facts.components(table(spark, sf_dir, "documents").select("source", F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")), "source")


# line items call parts of other orders; the seventh of an order calls what nobody knows
CALLED = "SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_partkey AS source_id, CASE WHEN l_linenumber <> 7 THEN l_orderkey % (SELECT max(p_partkey) FROM part) + 1 END AS target_id, l_returnflag AS target_ref, l_discount AS confidence FROM lineitem"


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_partkey").alias("source_id"), F.when(F.col("l_linenumber") != 7, F.col("l_orderkey") % parts + 1).alias("target_id"),
        F.col("l_returnflag").alias("target_ref"), F.col("l_discount").alias("confidence"),
    )


def starts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("start_id"))


def reached(start: str, depth: int) -> str:
    return f"WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM ({CALLED}) WHERE target_id IS NOT NULL), w AS (SELECT start_id, start_id AS symbol_id, 0 AS depth FROM ({start}) UNION SELECT w.start_id, e.target_id, depth + 1 FROM w JOIN e ON e.source_id = w.symbol_id WHERE depth < {depth}) SELECT start_id, symbol_id, min(depth) AS depth FROM w GROUP BY start_id, symbol_id"


NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS start_id FROM nation"
SUPPLIERS = "SELECT CAST(s_suppkey AS BIGINT) AS start_id FROM supplier"
# one edge a step: what is found, how deep, by which path; which node is expanded, and how many of its edges are done
TRACED = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_ref, relation_id) AS nth FROM ({CALLED})),
w AS (SELECT start_id, [start_id] AS found, [0] AS depths, [[start_id]] AS paths, 1 AS i, CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS relation_id, CAST(NULL AS BIGINT) AS target_id, CAST(NULL AS VARCHAR) AS kind FROM ({SUPPLIERS})
 UNION ALL SELECT start_id, CASE WHEN kind = 'tree' THEN list_append(found, target_id) ELSE found END, CASE WHEN kind = 'tree' THEN list_append(depths, depths[i] + 1) ELSE depths END, CASE WHEN kind = 'tree' THEN list_append(paths, list_append(paths[i], target_id)) ELSE paths END,
  CASE WHEN kind IS NULL THEN i + 1 ELSE i END, CASE WHEN kind IS NULL THEN 0 ELSE j + 1 END, relation_id, target_id, kind FROM (
  SELECT w.start_id, w.found, w.depths, w.paths, w.i, w.j, e.relation_id, e.target_id, CASE WHEN e.nth IS NULL THEN NULL WHEN e.target_id IS NULL THEN 'unresolved' WHEN list_contains(w.paths[w.i], e.target_id) THEN 'cycle' WHEN list_contains(w.found, e.target_id) THEN 'known' WHEN len(w.found) >= 12 THEN 'over' ELSE 'tree' END AS kind
  FROM w LEFT JOIN e ON e.source_id = w.found[w.i] AND e.nth = w.j + 1 AND e.nth <= 8 WHERE w.i <= len(w.found) AND w.depths[w.i] < 3))"""


@query(reached(SUPPLIERS, 2))
def bfs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(called(spark, sf_dir), starts(spark, sf_dir, "supplier", "s_suppkey"), 2)


@query(f"{TRACED}, n AS (SELECT start_id, arg_max(found, len(found)) AS found, arg_max(depths, len(found)) AS depths FROM w GROUP BY start_id) SELECT start_id, unnest(found) AS symbol_id, unnest(depths) AS depth, CAST(unnest(range(len(found))) AS INTEGER) AS queue_position FROM n")
def bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier's number as a symbol, 12 nodes and three calls deep, 8 edges of a node."""
    return graph.traces(called(spark, sf_dir), starts(spark, sf_dir, "supplier", "s_suppkey"), 3, 12, 8).nodes


@query(f"{TRACED} SELECT start_id, relation_id, target_id, CAST(depths[i] + 1 AS INTEGER) AS depth, kind FROM w WHERE kind IS NOT NULL AND kind <> 'unresolved'")
def bfs_capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traces(called(spark, sf_dir), starts(spark, sf_dir, "supplier", "s_suppkey"), 3, 12, 8).edges.drop("source_id")


@query(f"SELECT r.start_id, r.symbol_id, r.depth, count(l.doc_id) AS n_facts, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS quality FROM ({reached(NATIONS, 2)}) r LEFT JOIN labels l ON l.doc_id = r.symbol_id GROUP BY r.start_id, r.symbol_id, r.depth")
def bfs_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.reach(called(spark, sf_dir), starts(spark, sf_dir, "nation", "n_nationkey"), 2)
    per = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("symbol_id")).agg(F.count("*").alias("n_facts"), F.sum("quality").alias("quality"))
    return nodes.join(per, "symbol_id", "left").fillna(0, ["n_facts", "quality"])


NODE_FACTS = "SELECT l_partkey AS symbol_id, l_linenumber AS source_line, l_returnflag AS fact_type, l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem"


@query(f"""WITH n AS ({reached(NATIONS, 1)}), f AS ({NODE_FACTS}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY source_line, fact_type, fact_id) AS nth FROM f)
SELECT n.start_id, n.symbol_id, n.depth, coalesce(string_agg(k.fact_type || k.fact_id, ',' ORDER BY k.nth), '') AS facts FROM n LEFT JOIN k ON k.symbol_id = n.symbol_id AND k.nth <= 8 GROUP BY n.start_id, n.symbol_id, n.depth""")
def nodes_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached nodes with their first eight facts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_linenumber").alias("source_line"), F.col("l_returnflag").alias("fact_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"))
    found = graph.with_facts(graph.reach(called(spark, sf_dir), starts(spark, sf_dir, "nation", "n_nationkey"), 1), rows)
    said = F.array_join(F.transform("facts", lambda f: F.concat(f["fact_type"], f["fact_id"].cast("string"))), ",")
    return found.select("start_id", "symbol_id", "depth", F.coalesce(said, F.lit("")).alias("facts"))


@query("""WITH r AS (SELECT l_orderkey * 100000 + l_partkey AS relation_id, l_suppkey AS source_id, l_partkey % 100 + 1 AS target_id, l_returnflag AS target_ref, l_discount AS confidence FROM lineitem),
e AS (SELECT *, 'outgoing' AS side FROM r WHERE source_id = 7 UNION ALL SELECT *, 'incoming' FROM r WHERE target_id = 7)
SELECT side, relation_id, nth FROM (SELECT side, relation_id, row_number() OVER (PARTITION BY side ORDER BY confidence DESC, target_ref, relation_id) AS nth FROM e) WHERE nth <= 20""")
def symbol_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("relation_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 100 + 1).alias("target_id"), F.col("l_returnflag").alias("target_ref"), F.col("l_discount").alias("confidence"))
    return graph.neighbours(rows, 7).select("side", "relation_id", F.col("nth").cast("long").alias("nth"))


# each part is a module with a function and a class
MODULES = """SELECT 'src/m' || p_partkey || '.py' AS path, 'import m' || p_size || chr(10) || chr(10) || chr(10) || 'def f' || p_partkey || '(a):' || chr(10) || '    ' || repeat(chr(34), 3) || 'Doc ' || p_size || '.' || repeat(chr(34), 3) || chr(10) || '    return g' || p_size || '(a)' || chr(10) || chr(10) || chr(10)
 || 'class C' || p_size || ':' || chr(10) || '    def run(self):' || chr(10) || '        return f' || p_partkey || '(self)' || chr(10) AS content FROM part"""


@query("""WITH m AS (SELECT 'src/m' || p_partkey || '.py' AS path, 'f' || p_partkey AS f, 'C' || p_size AS c, 'Doc ' || p_size || '.' AS doc FROM part)
SELECT path, path AS name, 'file' AS qualified_name, 'file' AS kind, NULL AS signature, 1 AS start_line, 11 AS end_line, NULL AS parent, NULL AS docstring FROM m UNION ALL SELECT path, f, f, 'function', 'def ' || f || '(a):', 4, 6, NULL, doc FROM m
UNION ALL SELECT path, c, c, 'class', 'class ' || c || ':', 9, 11, NULL, NULL FROM m UNION ALL SELECT path, 'run', c || '.run', 'function', 'def run(self):', 10, 11, c, NULL FROM m""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.symbols(facts.extract(own(spark, sf_dir, MODULES)))


@query("""WITH m AS (SELECT 'src/m' || p_partkey || '.py' AS path, 'f' || p_partkey AS f, p_size AS n FROM part)
SELECT path, 'file' AS source, 'imports' AS relation_type, 'm' || n AS target_ref, 1 AS line, CAST(1.0 AS DOUBLE) AS confidence FROM m UNION ALL SELECT path, f, 'calls', 'g' || n, 6, 0.85 FROM m UNION ALL SELECT path, 'C' || n || '.run', 'calls', f, 11, 0.85 FROM m""")
def code_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relations(facts.extract(own(spark, sf_dir, MODULES)))


CONFIGS = [
    ("compose.yml", "services:\n  web:\n    image: web:1\n    environment:\n      API_TOKEN: abc\n    depends_on:\n      - db\n  db:\n    image: pg\n"),
    ("chart/values.yaml", "image:\n  tag: v1\nreplicas: 2\n"),
    ("chart/templates/d.yaml", "kind: Deployment\nname: \"{{ .Values.image.tag }}\"\n"),
    ("bad.yaml", "a: [1\n"),
    ("x.yaml", "a:\n  - b: 1\n  - c\n"),
]


SETTINGS = "SELECT 'conf/app' || p_partkey || '.yaml' AS path, 'image:' || chr(10) || '  tag: v' || p_size || chr(10) || 'replicas: ' || p_size || chr(10) || 'password: x' || p_partkey || chr(10) AS content FROM part"


@query("""WITH f AS (SELECT 'conf/app' || p_partkey || '.yaml' AS path, p_size AS n FROM part), r AS (SELECT path, 3 AS line, 'replicas' AS key_path, CAST(n AS VARCHAR) AS value FROM f UNION ALL SELECT path, 4, 'password', '[REDACTED]' FROM f UNION ALL SELECT path, 2, 'image.tag', 'v' || n FROM f)
SELECT *, 'yaml' AS parser_name, 'yaml' AS config_format, 'config_key' AS fact_type, 'scalar' AS value_kind, 'parsed' AS parse_status FROM r""")
def config_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.config_facts(own(spark, sf_dir, SETTINGS))


PROJECT = [
    ("go.mod", "module example.org/shop\n"),
    ("svc/__init__.py", ""),
    ("svc/app.py", "import grpc\nfrom kafka import KafkaProducer\napp = FastAPI()\nBASE_URL = 'x'\n\n@app.get('/items/{id}')\nasync def item(id):\n    return stub.GetItem(id)\n\n@celery.task\ndef nightly():\n    producer.send('orders', 1)\n\n@app.on_event('startup')\ndef up():\n    stub = CatalogStub(channel)\n    stub.GetItem(1)\n\nif __name__ == '__main__':\n    run()\n"),
    ("cmd/main.go", "package main\n\nfunc main() {\n\tr.GET(\"/ping\", ping)\n\thttp.HandleFunc(\"/x\", func(w W) {})\n}\n"),
    ("api/shop.proto", "service Shop {\n  rpc Get(Req) returns (Res);\n}\n"),
    ("deploy/values.yaml", "kafka:\n  KAFKA_TOPIC: orders\n  broker_password: x\nCATALOG_SERVICE_URL: http://catalog:80\nCATALOG_ADDR: catalog:9\nlist:\n  - KAFKA_GROUP: g1\n"),
    ("tests/test_x.py", "app = FastAPI()\n"),
    ("package.json", '{"name": "ui", "scripts": {"start": "vite"}}'),
]


SERVICES = """SELECT 'svc/p' || p_partkey || '.py' AS path, 'app' || p_size || ' = FastAPI()' || chr(10) || chr(10) || '@app' || p_size || '.get("/items/' || p_partkey || '")' || chr(10) || 'def item' || p_partkey || '():' || chr(10) || '    return 1' || chr(10) AS content FROM part"""


@query("""SELECT 'entrypoint' AS fact_type, 'app' || p_size AS name, 'FastAPI application' AS value, 'svc/p' || p_partkey || '.py' AS path, 1 AS line FROM part
UNION ALL SELECT 'http_api', 'item' || p_partkey, 'GET /items/' || p_partkey, 'svc/p' || p_partkey || '.py', 4 FROM part""")
def architecture_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a service of its own."""
    return architecture.extract(own(spark, sf_dir, SERVICES)).select("fact_type", "name", "value", "path", "line")


@query("""SELECT p_partkey, p_type, (SELECT count(*) FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'steel') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')) AS matches
FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'steel') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') ORDER BY p_partkey LIMIT 40 OFFSET 5""")
def inventory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    hits = rows.filter(T.has_any(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), ["steel", "brand#1"])).select("p_partkey", "p_type")
    total = hits.agg(F.count("*").alias("matches"))
    return access.page(hits.join(F.broadcast(total)), ["p_partkey"], 40, 5)


@query("SELECT p_brand, count(*) FILTER (p_size <= 10) AS parsed, count(*) FILTER (p_size > 10 AND p_size <= 30) AS inventoried, count(*) FILTER (p_size > 30) AS unsupported FROM part GROUP BY p_brand")
def parser_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(size <= 10).alias("parsed"), F.count_if((size > 10) & (size <= 30)).alias("inventoried"), F.count_if(size > 30).alias("unsupported"))


SCIP = "SELECT o_orderkey + 100 AS id, o_custkey || CASE o_orderkey % 5 WHEN 0 THEN ',0,9' WHEN 1 THEN ',0,' || (o_custkey + o_orderkey % 3) || ',0' WHEN 2 THEN ',0,' || (o_custkey + 4) || ',2' WHEN 3 THEN ',7,8' ELSE '' END AS r FROM orders UNION ALL SELECT * FROM (VALUES (1, '3,0,9'), (2, '3,0,5,0'), (3, '3,0,5,2'), (4, '3,0,3,0'), (5, '3')) AS t(id, r)"


@query(f"""WITH s AS (SELECT id, list_transform(string_split(r, ','), lambda x: CAST(x AS INTEGER)) AS a FROM ({SCIP}))
SELECT id, CASE WHEN len(a) IN (3, 4) THEN a[1] + 1 ELSE 1 END AS start_line, CASE WHEN len(a) = 3 THEN a[1] + 1 WHEN len(a) = 4 THEN CASE WHEN a[4] = 0 AND a[3] > a[1] THEN a[3] ELSE a[3] + 1 END ELSE 1 END AS end_line FROM s""")
def scip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = facts.scip_lines(F.transform(F.split("r", ","), lambda x: x.cast("int")))
    return own(spark, sf_dir, SCIP).select("id", lines["start"].alias("start_line"), lines["stop"].alias("end_line"))
