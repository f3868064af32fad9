"""Page layout from word boxes: lines, running headers and footers, columns, text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import is_page_number, line_fingerprint
from quillmark.session import cut, spread

SAME_LINE, GAP, MARGIN, MIDDLE = 3.0, 0.12, 0.14, 0.04
LINES = "doc_id int, page int, width double, height double, top double, bottom double, x0 double, x1 double, text string"


def lines(words: DataFrame) -> DataFrame:
    """words (doc_id, page, width, height, x0, x1, top, bottom, text) as lines: a word goes on with the last line if
    their tops are near and the gap is small. Each decision depends on the line built so far, so pages are streamed,
    sorted, through Arrow batches; a line is held, not a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in LINES.split(", ")]
        open_: dict | None = None

        def closed(line: dict) -> tuple:
            text = " ".join(w for _, w in sorted(line["words"], key=lambda w: w[0])).strip()
            return (*line["page"], line["top"], line["bottom"], line["x0"], line["x1"], text)

        for pdf in batches:
            out = []
            for w in pdf.itertuples(index=False):
                page = (w.doc_id, w.page, w.width, w.height)
                if open_ and open_["page"] == page and abs(w.top - open_["top"]) <= SAME_LINE and w.x0 - open_["x1"] <= w.width * GAP:
                    open_["words"].append((w.x0, w.text))
                    open_ |= {"bottom": max(open_["bottom"], w.bottom), "x0": min(open_["x0"], w.x0), "x1": max(open_["x1"], w.x1)}
                    continue
                if open_:
                    out.append(closed(open_))
                open_ = {"page": page, "top": w.top, "bottom": w.bottom, "x0": w.x0, "x1": w.x1, "words": [(w.x0, w.text)]}
            yield pd.DataFrame(out, columns=cols)
        if open_:
            yield pd.DataFrame([closed(open_)], columns=cols)

    own = spread(words, "doc_id", "page").sortWithinPartitions("doc_id", "page", "top", "x0")
    return own.mapInPandas(run, LINES)


def decorations(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint of the lines in page margins that recur on two pages and on half of all. pages (doc_id, page),
    if given, counts pages without lines too."""
    pages = (rows if pages is None else pages).groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    margin = (F.col("top") <= F.col("height") * MARGIN) | (F.col("bottom") >= F.col("height") * (1 - MARGIN))
    prints = rows.filter(margin).select("doc_id", "page", line_fingerprint(F.col("text")).alias("fingerprint")).filter(F.length("fingerprint") >= 3)
    seen = prints.groupBy("doc_id", "fingerprint").agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2))).select("doc_id", "fingerprint")


def page_text(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page, two_columns, text: without page numbers and decorations; two columns are read one after the other.
    Every page is there, an emptied one with an empty text; pages (doc_id, page), if given, adds those without lines."""
    rows = cut(rows)  # read four times
    kept = rows.withColumn("fingerprint", line_fingerprint(F.col("text"))).filter(~is_page_number(F.col("text"))).join(decorations(rows, pages), ["doc_id", "fingerprint"], "left_anti")
    mid, band = F.col("width") / 2, F.col("width") * MIDDLE
    shape = kept.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.count_if(F.col("x1") < mid - band).alias("left"), F.count_if(F.col("x0") > mid + band).alias("right"), F.count_if((F.col("x0") < mid) & (F.col("x1") > mid)).alias("across"),
        F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "text", mid.alias("mid")))).alias("lines"),
    )
    two = (F.col("n") >= 8) & (F.col("left") >= 3) & (F.col("right") >= 3) & (F.col("across") <= F.greatest(F.lit(1), F.floor(F.col("n") / 8)))
    ordered = F.when(two, F.concat(F.filter("lines", lambda x: x["x1"] < x["mid"]), F.filter("lines", lambda x: x["x0"] >= x["mid"]))).otherwise(F.col("lines"))
    texts = shape.select("doc_id", "page", two.alias("two_columns"), F.array_join(F.transform(F.filter(ordered, lambda x: x["text"] != ""), lambda x: x["text"]), "\n").alias("text"))
    every = (rows if pages is None else pages.select("doc_id", "page").union(rows.select("doc_id", "page"))).select("doc_id", "page").distinct()
    return every.join(texts, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("two_columns", F.lit(False)).alias("two_columns"), F.coalesce("text", F.lit("")).alias("text"))


def table_chunks(cells: DataFrame, size: int) -> DataFrame:
    """cells (table_id, row, col, text) of tables found on pages: chunk_index, content: rows as text under the column
    names, which every chunk repeats; a chunk ends before the row that would make it longer than size.

    Rows without text are left out, tables with less than two rows give nothing, columns without a name get a number.
    Which chunk a row is in depends on the rows before it in the chunk: a fold over one table's rows."""
    clean = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", clean.alias("text")))).alias("c")).filter(F.exists("c", lambda x: x["text"] != ""))
    tables = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", F.transform("c", lambda x: x["text"]).alias("t")))).alias("rows")).filter(F.size("rows") > 1)
    named = F.transform(F.get("rows", F.lit(0))["t"], lambda v, i: F.when(v == "", F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(v))
    body = F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: F.concat(F.lit("表格行："), F.array_join(F.transform(r["t"], lambda v, i: F.concat(F.coalesce(F.get(F.col("names"), i), F.concat(F.lit("列"), (i + 1).cast("string"))), F.lit("："), v)), "；")))
    head = F.concat(F.lit("表格列："), F.array_join("names", "；"))
    own = tables.withColumn("names", named).withColumn("head", head).withColumn("body", body)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, line):
        longer = F.concat(F.when(acc["open"] == "", F.col("head")).otherwise(acc["open"]), F.lit("\n"), line)
        full = (F.length(longer) > size) & (acc["open"] != "")
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, F.concat(F.col("head"), F.lit("\n"), line)).otherwise(longer).alias("open"))

    return own.select("table_id", F.posexplode(F.aggregate("body", start, step, lambda acc: F.array_append(acc["done"], acc["open"]))).alias("chunk_index", "content"))
