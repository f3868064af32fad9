"""Where queries are registered with the SQL that must give the same rows (None: tested otherwise)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OWN = re.compile(r"(FROM|JOIN) (region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b")


def own(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of a text that both engines read alike. Tables named in `dealt` are dealt by these columns over a given number
    of tasks first: what groups by them has no larger parts then."""
    names = {name for _, name in OWN.findall(sql)}
    read = lambda n: spread(table(spark, sf_dir, n), *dealt[n]) if dealt and n in dealt else table(spark, sf_dir, n)
    return spark.sql(OWN.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}")), **{n: read(n) for n in names})
