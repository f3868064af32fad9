"""A training corpus from documents: five stages, each calling one operator of quillmark.llm.

Each stage takes what its predecessor kept, written as Parquet and read again by whoever runs the stages; run() writes
between them itself, in the folder that the session names in spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import language, packing, simhash, substrings, toxicity
from quillmark.llm.common import ready, table

#: Least share of a document's n-grams that the learnt languages' landmarks know; least Jaccard similarity of near copies' five-word shingles.
LEAST_KNOWN, ALIKE = 0.3, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is in no learnt language goes; the others carry the language found, by which the last stage packs."""
    return language.named(docs, language.fit(docs), LEAST_KNOWN)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, simhash.near_copies(docs, ALIKE))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(docs, "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096, by="lang")


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("substrings", substring_stage), ("packing", packing_stage)]

#: Models and hashes of the stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
