"""Constraints as queries: each check counts what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (nulls don't count, as in a unique constraint)."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.filter(known).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def mismatched(children: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """Children whose column differs from their parent's."""
    p = parents.select(F.col(key).alias("_k"), F.col(column).alias("_c"))
    return children.join(p, F.col(key) == F.col("_k")).filter(~F.col(column).eqNullSafe(F.col("_c"))).drop("_k", "_c")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations: one row for each check."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, df in checks.items()])


def apart(rows: DataFrame, key: str, parent: str, columns: list[str]) -> DataFrame:
    """Rows that differ from their parent row of the same table in one of the columns."""
    p = rows.select(F.col(key).alias("_p"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return rows.join(p, F.col(parent) == F.col("_p")).filter(differs).select(*rows.columns)


def missing_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which one of the columns is null or an empty text."""
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns]))


def bad_pointers(rows: DataFrame, pointer: str, targets: DataFrame, key: str, same: str) -> DataFrame:
    """Rows whose pointer is null, leads nowhere, or leads to a row of another `same`."""
    t = targets.select(F.col(key).alias("_t"), F.col(same).alias("_s"))
    return rows.join(t, F.col(pointer) == F.col("_t"), "left").filter(F.col("_t").isNull() | ~F.col(same).eqNullSafe(F.col("_s"))).select(*rows.columns)


def differences(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the tables has, with the fault: missing or extra. Empty if they are equal as sets."""
    both = wanted.select(*keys, F.lit(1).alias("_w")).union(found.select(*keys, F.lit(2).alias("_w")))
    sides = both.groupBy(*keys).agg(F.bit_or("_w").alias("_w")).filter("_w < 3")
    return sides.select(*keys, F.when(F.col("_w") == 1, "missing").otherwise("extra").alias("fault"))


def readiness(spark: SparkSession, tables: dict[str, DataFrame], wanted: dict[str, dict[str, str]]) -> DataFrame:
    """What keeps the tables from being used: tab, col, fault (missing or wrong type). No table is read."""
    faults: list[tuple[str, str | None, str]] = []
    for name, columns in wanted.items():
        have = dict(tables[name].dtypes) if name in tables else None
        if have is None:
            faults.append((name, None, "missing"))
        else:
            faults += [(name, c, "missing" if c not in have else "wrong type") for c, t in columns.items() if have.get(c) != t]
    return spark.createDataFrame(faults, "tab string, col string, fault string")
