"""Catalogue, access and integrity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, catalog, integrity, upserts
from quillmark.plans.recall import SCOPED, scoped
from quillmark.plans.registry import own, query, table

WITH_OWNER = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS owner, lang FROM documents"


@query(f"SELECT a.doc_id, count(*) AS n_same FROM ({WITH_OWNER}) a JOIN ({WITH_OWNER}) b ON a.owner IS NOT DISTINCT FROM b.owner AND a.lang IS NOT DISTINCT FROM b.lang  GROUP BY a.doc_id")
def null_safe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("source")).alias("owner"), "lang")
    sizes = rows.groupBy("owner", "lang").agg(F.count("*").alias("n_same"))  # counted before the join: no pairs are made
    return rows.join(sizes, catalog.null_safe(rows, sizes, ["owner", "lang"])).select("doc_id", "n_same")


STATE = "doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'wiki' ELSE 'rag' END AS source_type, '/d/' || doc_id AS source_path, source AS workspace_id, 'workspace' AS scope_type, CAST(NULL AS VARCHAR) AS owner_user_id, CAST(NULL AS VARCHAR) AS owner_department_id, CASE WHEN doc_id % 4 < 3 THEN 'u' || doc_id % 2 END AS created_by_user_id"
EXISTING = f"SELECT {STATE}, sha256(text) AS content_hash, CAST(1 + doc_id % 3 AS BIGINT) AS current_revision FROM documents WHERE doc_id % 2 = 0"
INCOMING = f"SELECT {STATE}, sha256(CASE WHEN doc_id % 7 = 0 THEN 'changed ' || text ELSE text END) AS content_hash FROM documents"


def states(docs: DataFrame) -> DataFrame:
    none, id_ = F.lit(None).cast("string"), F.col("doc_id")
    return docs.select(
        id_.alias("document_id"), F.when(id_ % 3 == 0, "wiki").otherwise("rag").alias("source_type"), F.concat(F.lit("/d/"), id_.cast("string")).alias("source_path"), F.col("source").alias("workspace_id"), F.lit("workspace").alias("scope_type"),
        none.alias("owner_user_id"), none.alias("owner_department_id"), F.when(id_ % 4 < 3, F.concat(F.lit("u"), (id_ % 2).cast("string"))).alias("created_by_user_id"), "lang", "n_chars", "text",
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(table(spark, sf_dir, "documents")).filter("document_id % 2 = 0")
    return own.withColumn("content_hash", T.sha256(F.col("text"))).withColumn("current_revision", 1 + F.col("document_id") % 3).drop("text", "lang", "n_chars")


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("document_id") % 7 == 0, F.concat(F.lit("changed "), F.col("text"))).otherwise(F.col("text"))
    return states(table(spark, sf_dir, "documents")).withColumn("content_hash", T.sha256(changed)).drop("text", "lang", "n_chars")


OWNED = "workspace_id, scope_type, owner_user_id, owner_department_id, created_by_user_id"


def one_by_one(existing: str, incoming: str) -> str:
    """The rows one after another over a list of what each place holds; targets and revisions follow from the changes."""
    keys = f"hash(source_type, source_path, {OWNED}) AS place, hash(content_hash, {OWNED}) AS content"
    return f"""WITH RECURSIVE e AS (SELECT *, {keys} FROM ({existing})), i AS (SELECT *, {keys}, row_number() OVER (ORDER BY document_id) AS k FROM ({incoming})),
run AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list({{'place': place, 'content': content}}) FROM e) AS docs, CAST(NULL AS VARCHAR) AS change
 UNION ALL SELECT k, CASE change WHEN 'updated' THEN list_append(list_filter(docs, lambda x: x.place <> place), {{'place': place, 'content': content}}) WHEN 'created' THEN list_append(docs, {{'place': place, 'content': content}}) ELSE docs END, change
 FROM (SELECT i.k, run.docs, i.place, i.content, CASE WHEN len(list_filter(docs, lambda x: x.place = i.place AND x.content = i.content)) > 0 THEN 'unchanged' WHEN len(list_filter(docs, lambda x: x.place = i.place)) > 0 THEN 'updated'
  WHEN len(list_filter(docs, lambda x: x.content = i.content)) > 0 THEN 'reused' ELSE 'created' END AS change FROM run JOIN i ON i.k = run.k + 1)),
c AS (SELECT i.*, change, lead(i.k) OVER (PARTITION BY place ORDER BY i.k) AS stop FROM i JOIN run ON run.k = i.k),
p AS (SELECT place, document_id AS id, current_revision AS base FROM e UNION ALL SELECT place, document_id, 0 FROM c WHERE change = 'created'),
s AS (SELECT c.k, id, content, stop, base + count(*) FILTER (change IN ('created', 'updated')) OVER (PARTITION BY place ORDER BY c.k) AS revision FROM c JOIN p USING (place) WHERE change <> 'reused'
 UNION ALL SELECT 0, document_id, content, (SELECT min(k) FROM c WHERE c.place = e.place), current_revision FROM e),
held AS (SELECT c.k, arg_min({{'id': s.id, 'revision': s.revision}}, (-coalesce(s.stop, 1000000000000), s.id)) AS h FROM c JOIN s ON s.content = c.content AND s.k < c.k AND (s.stop IS NULL OR s.stop > c.k) WHERE change = 'reused' GROUP BY c.k)
SELECT c.document_id, c.content_hash, c.change, coalesce(h.id, s.id) AS target_id, CAST(coalesce(h.revision, s.revision) AS BIGINT) AS revision FROM c LEFT JOIN held USING (k) LEFT JOIN s ON s.k = c.k AND c.change <> 'reused'"""


CLASSIFIED = one_by_one(EXISTING, INCOMING)
# Paths that several rows of a batch share, and contents that come and go: what a row finds depends on the rows before it.
CROWDED = f"SELECT * REPLACE ('/d/' || document_id % 53 AS source_path, 'w' AS workspace_id), sha256(lang || n_chars % 40) AS content_hash FROM (SELECT {STATE}, lang, n_chars FROM documents)"
CROWDED_BEFORE = f"SELECT *, CAST(1 AS BIGINT) AS current_revision FROM ({CROWDED}) WHERE document_id < 25"
CROWDED_BATCH = f"SELECT * FROM ({CROWDED}) WHERE document_id >= 25"


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = states(table(spark, sf_dir, "documents")).withColumns({
        "source_path": F.concat(F.lit("/d/"), (F.col("document_id") % 53).cast("string")), "workspace_id": F.lit("w"), "content_hash": T.sha256(F.concat("lang", (F.col("n_chars") % 40).cast("string"))),
    }).drop("text", "lang", "n_chars")
    return own.filter("document_id < 25").withColumn("current_revision", F.lit(1).cast("long")), own.filter("document_id >= 25")


@query(f"SELECT document_id, change, target_id, revision FROM ({CLASSIFIED})")
def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.classify(stored(spark, sf_dir), sent(spark, sf_dir)).select("document_id", "change", "target_id", "revision")


@query(f"SELECT document_id, change, target_id, revision FROM ({one_by_one(CROWDED_BEFORE, CROWDED_BATCH)})")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.classify(*crowded(spark, sf_dir)).select("document_id", "change", "target_id", "revision")


@query(f"SELECT target_id AS document_id, revision AS revision_no, content_hash, change AS change_type, row_number() OVER (PARTITION BY target_id ORDER BY revision DESC) AS nth FROM ({one_by_one(CROWDED_BEFORE, CROWDED_BATCH)}) WHERE change IN ('created', 'updated')")
def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_first(upserts.revisions(upserts.classify(*crowded(spark, sf_dir))), "document_id", "revision_no").withColumn("nth", F.col("nth").cast("long"))


@query(f"""WITH c AS ({one_by_one(CROWDED_BEFORE, CROWDED_BATCH)}), n AS (SELECT target_id, max(revision) AS revision, arg_max(content_hash, revision) AS content_hash FROM c WHERE change IN ('created', 'updated') GROUP BY target_id),
e AS (SELECT *, CASE WHEN document_id % 2 = 0 THEN 'invalid' ELSE 'active' END AS status FROM ({CROWDED_BEFORE}))
SELECT coalesce(e.document_id, n.target_id) AS document_id, coalesce(n.content_hash, e.content_hash) AS content_hash, coalesce(n.revision, e.current_revision) AS current_revision, CASE WHEN n.target_id IS NULL THEN e.status ELSE 'active' END AS status, CASE WHEN n.target_id IS NULL AND e.status = 'invalid' THEN 'old' END AS invalid_reason
FROM e FULL JOIN n ON n.target_id = e.document_id""")
def upserted_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after the batch: what was invalid and is revised is active again."""
    existing, batch = crowded(spark, sf_dir)
    existing = existing.withColumn("status", F.when(F.col("document_id") % 2 == 0, "invalid").otherwise("active")).withColumn("invalid_reason", F.when(F.col("status") == "invalid", "old"))
    return upserts.upserted(existing, upserts.classify(existing, batch)).select("document_id", "content_hash", "current_revision", "status", "invalid_reason")


@query(f"""WITH e AS ({EXISTING}), i AS ({INCOMING}) SELECT i.document_id, coalesce((SELECT min(e.document_id) FROM e WHERE e.content_hash = i.content_hash AND e.source_type = i.source_type AND e.source_path = i.source_path AND e.workspace_id = i.workspace_id AND e.created_by_user_id IS NOT DISTINCT FROM i.created_by_user_id),
 (SELECT min(e.document_id) FROM e WHERE e.content_hash = i.content_hash AND e.workspace_id = i.workspace_id AND e.created_by_user_id IS NOT DISTINCT FROM i.created_by_user_id)) AS reusable_id FROM i""")
def reuse_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.reusable(stored(spark, sf_dir), sent(spark, sf_dir)).select("document_id", "reusable_id")


@query("""SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'invalid' ELSE CASE WHEN d.doc_id % 5 = 0 THEN 'invalid' ELSE 'active' END END AS status, CASE WHEN l.quality = 0 AND d.doc_id % 5 <> 0 THEN 'low quality' END AS invalid_reason, coalesce(l.quality = 0 AND d.doc_id % 5 <> 0, false) AS changed
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def invalidate_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "invalid").otherwise("active").alias("status"), F.lit(None).cast("string").alias("invalid_reason"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return catalog.set_status(rows, F.col("quality") == 0, "invalid", "low quality").drop("quality")


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def reuse_probe_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("content_hash"))
    return catalog.only(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0").select("content_hash"), ["content_hash"]).select("doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS chunk_count FROM customer c")
def list_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o.o_orderkey, count(DISTINCT l.l_linenumber) AS n_symbols, count(DISTINCT p.p_brand) AS n_relations FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.o_orderkey")
def file_counts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("n_symbols"), F.count_distinct("p_brand").alias("n_relations"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").fillna(0, ["n_symbols", "n_relations"])


@query("SELECT c.c_custkey, coalesce(string_agg(s, ',' ORDER BY s) FILTER (r <= 8), '') AS statuses FROM customer c LEFT JOIN (SELECT o_custkey, s, row_number() OVER (PARTITION BY o_custkey ORDER BY s) AS r FROM (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders)) x ON x.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def scope_arrays_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = access.lists_of(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("s")), "c_custkey", "s")
    return table(spark, sf_dir, "customer").select("c_custkey").join(lists, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("s_list", ","), F.lit("")).alias("statuses"))


PROJECTS = "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'workspace' ELSE 'private' END AS access_scope, 'u' || c_nationkey AS owner_user_id FROM customer"


@query(f"SELECT project_id, access_scope FROM ({PROJECTS}) p WHERE access_scope = 'workspace' OR owner_user_id = 'u7' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.project_id AND o.o_orderpriority = '1-URGENT' AND o.o_orderkey % 5 = 0)")
def acl_exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 4 == 0, "workspace").otherwise("private").alias("access_scope"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("owner_user_id"))
    grants = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("project_id"), F.lit("u7").alias("user_id"))
    return access.open_or_granted(projects, grants, "u7").select("project_id", "access_scope")


ROLE = "CASE doc_id % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'editor' WHEN 3 THEN 'viewer' ELSE 'guest' END"


@query(f"""SELECT doc_id, CAST(rank AS BIGINT) AS role_rank, coalesce((rank >= 3 AND scope_type <> 'personal') OR (scope_type = 'personal' AND owner_user_id = 'u2') OR (rank >= 2 AND scope_type = 'workspace' AND created = 'u2'), false) AS can_manage
FROM (SELECT *, CASE {ROLE} WHEN 'owner' THEN 4 WHEN 'admin' THEN 3 WHEN 'editor' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END AS rank, 'u' || doc_id % 6 AS created FROM ({SCOPED}))""")
def role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ["owner", "admin", "editor", "viewer", "guest"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = scoped(table(spark, sf_dir, "documents")).withColumn("created_by_user_id", F.concat(F.lit("u"), (F.col("doc_id") % 6).cast("string")))
    return rows.select("doc_id", access.role_rank(role).alias("role_rank"), F.coalesce(access.can_manage(role, F.lit("u2")), F.lit(False)).alias("can_manage"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1%' OR p_brand ILIKE '%1%' OR p_type ILIKE '%1%' ORDER BY CASE WHEN lower(p_name) = '1' THEN 0 ELSE 1 END, length(p_name), p_name, p_partkey LIMIT 30")
def exact_first_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.search(table(spark, sf_dir, "part"), "1", ["p_name", "p_brand", "p_type"], "p_name", [F.length("p_name"), "p_name", "p_partkey"], 30).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part ORDER BY p_brand, p_partkey LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.page(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], 25, 50)


GRANTS = "SELECT l_suppkey AS user_id, 'p' || l_partkey AS project_id, CASE l_linenumber % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'read' ELSE 'write' END AS permission FROM lineitem UNION ALL SELECT * FROM (VALUES (1, 'p1', 'read'), (1, 'p1', 'admin'), (1, 'p2', 'write'), (2, 'p1', 'read'), (2, 'p1', 'write'), (3, 'p3', 'read')) AS t(user_id, project_id, permission)"


@query(f"SELECT user_id, project_id, CASE max(CASE permission WHEN 'admin' THEN 3 WHEN 'write' THEN 2 ELSE 1 END) WHEN 3 THEN 'admin' WHEN 2 THEN 'write' ELSE 'read' END AS permission FROM ({GRANTS}) GROUP BY user_id, project_id")
def permission_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.strongest(own(spark, sf_dir, GRANTS), ["user_id", "project_id"], "permission", access.PERMISSIONS)


@query("SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def earliest_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.first_of_each(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", ["c_acctbal", "c_custkey"])


@query("""SELECT 'chunk_workspace' AS "check", count(*) AS violations FROM documents d JOIN labels l USING (doc_id) WHERE CASE WHEN d.doc_id % 50 = 0 THEN 'other' ELSE d.source END IS DISTINCT FROM d.source
UNION ALL SELECT 'orphan_labels', count(*) FROM labels WHERE doc_id + CASE WHEN doc_id % 97 = 0 THEN 10000000 ELSE 0 END NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'bad_language', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT 'duplicate_hash', count(*) FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chunks = labels.select("doc_id").join(docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("source")).alias("source")), "doc_id")
    moved = labels.select((F.col("doc_id") + F.when(F.col("doc_id") % 97 == 0, 10_000_000).otherwise(0)).alias("doc_id"))
    return integrity.report({
        "chunk_workspace": integrity.mismatched(chunks, docs, "doc_id", "source"), "orphan_labels": integrity.dangling(moved, "doc_id", docs, "doc_id"),
        "bad_language": integrity.outside(docs, "lang", ["en", "de", "fr"]), "duplicate_hash": integrity.duplicates(docs.select(T.sha256(F.col("text")).alias("h")), ["h"]),
    })


@query("SELECT source, sha256(string_agg('/d/' || doc_id || ':' || sha256(text) || ':' || n_chars, chr(10) ORDER BY '/d/' || doc_id)) AS version, count(*) AS n_files FROM documents GROUP BY source")
def version_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), T.sha256(F.col("text")).alias("content_hash"), F.col("n_chars").alias("size_bytes"))
    return catalog.fingerprint(files, "source")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'active' WHEN doc_id % 5 = 0 THEN 'invalid' ELSE 'active' END AS status, doc_id % 5 = 0 AND doc_id % 2 = 0 AS changed FROM documents""")
def restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "invalid").otherwise("active").alias("status"), F.lit("x").alias("invalid_reason"))
    return catalog.set_status(docs, F.col("doc_id") % 2 == 0, "active").drop("invalid_reason")


MEMBERS = """SELECT 'w' || o_orderkey % 25 AS workspace_id, 'c' || o_custkey AS user_id, CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'owner' WHEN '2-HIGH' THEN 'admin' WHEN '3-MEDIUM' THEN 'editor' ELSE 'viewer' END AS role, CASE WHEN max(o_orderstatus) = 'F' THEN 'left' ELSE 'active' END AS status, CAST(min(o_orderkey) AS INTEGER) AS joined_at FROM orders GROUP BY 1, 2
 UNION ALL SELECT * FROM (VALUES ('w1', 'u1', 'owner', 'active', 3), ('w2', 'u1', 'viewer', 'active', 1), ('w3', 'u1', 'admin', 'left', 0), ('w1', 'u2', 'editor', 'active', 2), ('w2', 'u3', 'owner', 'active', 2)) AS t(workspace_id, user_id, role, status, joined_at)"""


@query(f"""SELECT 'earliest' AS asked, workspace_id, role FROM (SELECT * FROM ({MEMBERS}) WHERE user_id = 'u1' AND status = 'active' ORDER BY joined_at, workspace_id LIMIT 1)
UNION ALL SELECT 'default', workspace_id, role FROM ({MEMBERS}) WHERE user_id = 'u1' AND status = 'active' AND workspace_id = 'w1' UNION ALL SELECT 'requested', workspace_id, role FROM ({MEMBERS}) WHERE user_id = 'u2' AND status = 'active' AND workspace_id = 'w1'""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cols = own(spark, sf_dir, MEMBERS), ["workspace_id", "role"]
    earliest = access.member_workspace(rows, "u1").select(F.lit("earliest").alias("asked"), *cols)
    default = access.member_workspace(rows, "u1", default="w1").select(F.lit("default").alias("asked"), *cols)
    return earliest.union(default).union(access.member_workspace(rows, "u2", requested="w1").select(F.lit("requested").alias("asked"), *cols))


@query(f"SELECT workspace_id, user_id, role, row_number() OVER (PARTITION BY workspace_id ORDER BY CASE role WHEN 'owner' THEN 4 WHEN 'admin' THEN 3 WHEN 'editor' THEN 2 ELSE 1 END DESC, user_id) AS nth FROM ({MEMBERS}) WHERE status = 'active'")
def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.members(own(spark, sf_dir, MEMBERS).filter("status = 'active'")).select("workspace_id", "user_id", "role", F.col("nth").cast("long").alias("nth"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def open_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, at).alias("accepted_at"), F.when(F.col("event_id") % 5 == 0, at).alias("revoked_at"), (at + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return access.open_tokens(rows, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("event_id")


@query("""WITH s AS (SELECT source AS project_id, sha256(string_agg('/d/' || doc_id || ':' || sha256(text) || ':' || n_chars, chr(10) ORDER BY '/d/' || doc_id)) AS version FROM documents WHERE source <> 'src4' GROUP BY source),
p AS (SELECT DISTINCT source AS project_id FROM documents) SELECT p.project_id, CASE WHEN s.version IS NULL THEN 'missing' ELSE 'changed' END AS fault FROM p LEFT JOIN s USING (project_id) WHERE s.version IS NULL OR p.project_id IN ('src1', 'src2')""")
def changed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions of projects of which two are old, against a scan that found one project less."""
    docs = table(spark, sf_dir, "documents")
    files = docs.filter("source <> 'src4'").select(F.col("source").alias("project_id"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), T.sha256(F.col("text")).alias("content_hash"), F.col("n_chars").alias("size_bytes"))
    scanned = catalog.fingerprint(files, "project_id")
    old = F.col("project_id").isin("src1", "src2")
    stored = docs.select(F.col("source").alias("project_id")).distinct().join(scanned, "project_id", "left").select("project_id", F.when(old, "old").otherwise(F.coalesce("version", F.lit("gone"))).alias("commit_hash"))
    return catalog.changed_snapshots(stored, scanned).select("project_id", "fault")
