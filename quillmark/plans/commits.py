"""Commits over several tables: what pinned readers see before and after."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import catalog
from quillmark.plans.registry import query, table
from quillmark.session import cut, shared_folder
from quillmark.versions import Tables


@query("""WITH d AS (SELECT doc_id, source, n_chars FROM documents), b AS (SELECT * FROM d WHERE doc_id % 3 = 0), r AS (SELECT * FROM d WHERE doc_id % 3 = 1)
SELECT 1 AS version, source, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) AS n_log FROM b GROUP BY source
UNION ALL SELECT 2, source, count(*), CAST(sum(n_chars) AS BIGINT), (SELECT count(*) FROM d x WHERE x.doc_id % 3 < 2 AND x.source = u.source) FROM (SELECT doc_id, source, n_chars FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM r) u GROUP BY source""")
def pinned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and a log, committed together twice; each version is read after both commits. The second transaction drops
    some documents, adds others and appends to the log; a third one fails."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    tables = Tables(spark, folder)
    first, second = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1")
    tables.run(lambda tx: (tx.put("documents", first), tx.append("log", first.select("doc_id", "source"))))
    tables.run(lambda tx: (tx.put("documents", tx["documents"].filter("doc_id % 2 = 0").union(second)), tx.append("log", second.select("doc_id", "source"))))
    try:
        with tables.transaction() as tx:
            tx.put("documents", docs)
            raise InterruptedError
    except InterruptedError:
        pass
    found = [
        catalog.with_counts(v["documents"].groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars")), v["log"], "source").select(F.lit(v.number).alias("version"), "source", "n_documents", "n_chars", F.col("chunk_count").alias("n_log"))
        for v in (tables.version(n) for n in tables.numbers())
    ]
    result = cut(found[0].union(found[1]))
    tables.files.drop(folder)
    return result
