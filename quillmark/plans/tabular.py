"""Queries through SQL's table functions, the data source of code indexes and the reader of page files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import tables
from quillmark.operators import layout
from quillmark.plans.chunks import CHILDREN, PARENTS, SCRIPTS, TITLED
from quillmark.plans.registry import own, query, table
from quillmark.session import shared_folder, spread
from quillmark.sources import indexes, pdf, scip


@query(f"""SELECT doc_id, lang, CAST(chunk_index AS INTEGER) AS parent_index, CAST(NULL AS INTEGER) AS child_index, content FROM ({PARENTS}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
UNION ALL SELECT pk // 100000, lang, CAST(pk % 100000 AS INTEGER), chunk_index, content FROM ({CHILDREN}) c JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = c.pk // 100000""")
def sql_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children of all documents, asked for in SQL; another column of the table goes along."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, lang, parent_index, child_index, content FROM split_parents(TABLE(SELECT doc_id, lang, text FROM {docs}), text => 'text')", docs=table(spark, sf_dir, "documents"))


@query("""SELECT 'Part ' || p_size AS section, count(*) AS n FROM part GROUP BY p_size""")
def sql_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a section of each name."""
    tables.register(spark)
    return spark.sql("SELECT substring_index(ref, ' > ', -1) AS section, count(DISTINCT doc_id) AS n FROM split_markdown(TABLE({docs}) PARTITION BY doc_id, text => 'text') WHERE chunk_index = 1 GROUP BY 1", docs=spread(own(spark, sf_dir, TITLED), "doc_id"))


@query("""SELECT 'g' || p_size AS name, count(*) AS n, CAST(min(p_partkey) AS BIGINT) AS least FROM part GROUP BY p_size
UNION ALL SELECT 'f' || p_partkey, 1, CAST(p_partkey AS BIGINT) FROM part""")
def sql_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by name over all sources."""
    tables.register(spark)
    return spark.sql("SELECT name, count(*) AS n, min(CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)) AS least FROM code_symbols(TABLE({s}), path => 'path', text => 'text') WHERE kind = 'function' GROUP BY name", s=spread(own(spark, sf_dir, SCRIPTS), "path"))


@query("""SELECT 'src/m' || p_partkey || '.go' AS path, 'pkg/F' || p_partkey || '().' AS symbol, CAST(p_size AS BIGINT) AS line, p_name AS documentation FROM part WHERE p_size % 5 <> 0""")
def index_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and what is said of them, from code indexes that are written and read as a data source."""
    indexes.register(spark)
    key, none = F.col("p_partkey").cast("string"), F.lit(None)
    path, symbol = F.concat(F.lit("src/m"), key, F.lit(".go")), F.concat(F.lit("pkg/F"), key, F.lit("()."))
    place = F.array(F.col("p_size"), F.lit(4), F.lit(300)).cast("array<int>")
    made = {"record": F.explode(F.array(F.lit("occurrence"), F.lit("symbol"))), "path": path, "symbol": symbol, "roles": F.when(F.col("p_size") % 5 == 0, 0).otherwise(1), "range": place, "kind": F.lit(17), "documentation": F.col("p_name")}
    rows = table(spark, sf_dir, "part").select(*[made.get(name, none).cast(kind).alias(name) if name != "record" else made["record"].alias(name) for name, kind in (c.split() for c in scip.ROW.split(", "))])
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    spread(rows, "path").sortWithinPartitions("path").write.format("code_index").mode("append").save(folder)  # the rows of a path are in one partition
    read = lambda records: spark.read.format("code_index").option("split_bytes", 1 << 20).option("records", records).load(folder)
    defined = read("occurrence").filter("roles = 1").select("path", "symbol", F.col("range")[0].cast("long").alias("line"))
    said = read("symbol").select("path", "symbol", "documentation")
    return defined.join(said, ["path", "symbol"])


def page_files(parts: DataFrame) -> DataFrame:
    """doc_id, content: a file of two pages for each part, a header and a page number on both."""
    shown = lambda number, *lines: F.concat(F.lit("BT /F1 10 Tf 72 780 Td (Parts catalogue) Tj 0 -120 Td 14 TL ("), F.concat_ws(") Tj T* (", *lines), F.lit(f") Tj ET BT /F1 10 Tf 300 20 Td ({number}) Tj ET"))
    key = F.col("p_partkey").cast("string")
    texts = [shown(1, F.concat(F.lit("Part "), key), F.col("p_name")), shown(2, F.concat(F.lit("Kind "), F.col("p_type")))]
    streams = [F.concat(F.lit("<< /Length "), F.octet_length(t).cast("string"), F.lit(" >>\nstream\n"), t, F.lit("\nendstream")) for t in texts]
    page = lambda contents: F.lit(f"<< /Type /Page /Parent 2 0 R /Contents {contents} 0 R >>")
    bodies = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /F1 7 0 R >> >> >>"),
        page(5), page(6), *streams, F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"),
    ]
    objects = [F.concat(F.lit(f"{i} 0 obj\n"), b, F.lit("\nendobj\n")) for i, b in enumerate(bodies, 1)]
    head, sizes = "%PDF-1.4\n", [F.octet_length(o) for o in objects]
    place = [sum(sizes[:i], F.lit(len(head))) for i in range(len(objects) + 1)]
    table_ = [F.concat(F.lpad(p.cast("string"), 10, "0"), F.lit(" 00000 n \n")) for p in place[:-1]]
    whole = F.concat(F.lit(head), *objects, F.lit(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n"), *table_, F.lit(f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n"), place[-1].cast("string"), F.lit("\n%%EOF\n"))
    return spread(parts.select("p_partkey", "p_name", "p_type"), "p_partkey").select(F.col("p_partkey").cast("int").alias("doc_id"), whole.cast("binary").alias("content"))


@query("""SELECT CAST(p_partkey AS INTEGER) AS doc_id, 1 AS page, 'Part ' || p_partkey || chr(10) || p_name AS text FROM part
UNION ALL SELECT CAST(p_partkey AS INTEGER), 2, 'Kind ' || p_type FROM part""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages from the files' bytes: without running headers and page numbers."""
    rows = pdf.read(page_files(table(spark, sf_dir, "part")))
    return layout.page_text(layout.lines(pdf.words(rows))).select("doc_id", "page", "text")


@query("""WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part), i AS (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT CAST(p_partkey AS INTEGER) AS doc_id, ws[i] AS text, CAST(72 + 6 * (coalesce(length(array_to_string(ws[1:i - 1], ' ')), 0) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS BIGINT) AS x0, CAST(6 * length(ws[i]) AS BIGINT) AS width FROM i""")
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the words of a line, in points."""
    rows = pdf.words(pdf.read(page_files(table(spark, sf_dir, "part")))).filter("page = 1 AND top BETWEEN 140 AND 154.5 AND x0 < 300 AND bottom > 153")
    return rows.select("doc_id", "text", F.round("x0").cast("long").alias("x0"), F.round(F.col("x1") - F.col("x0")).cast("long").alias("width"))
