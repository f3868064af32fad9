"""The registered queries of the training-data operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import conversations, periods, rules
from quillmark.llm.bpe import round_trip
from quillmark.llm.common import table
from quillmark.llm.fingerprints import compare
from quillmark.llm.language import identify
from quillmark.llm.packing import pack
from quillmark.llm.sharding import shard
from quillmark.llm.simhash import near_duplicates
from quillmark.llm.substrings import repeats
from quillmark.llm.toxicity import classify
from quillmark.llm.transport import media_columns
from quillmark.llm.urls import judge

Query = Callable[[SparkSession, str], DataFrame]

# The rules that the url query is asked for.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=24)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), keep_media=False)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


REGISTERED = (
    op1_packing, op2_language, op3_sharding, op4_bpe, op5_simhash, op6_toxicity, op7_urls, op8_media, op9_substrings, op10_fingerprints,
    op11_quality, op12_periods, op13_conversations,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {}
