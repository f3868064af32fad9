"""What came before in a key's order, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key and bucket on average, if the key had all rows.
BUCKET_ROWS = 65_536


def key_of(*columns: str) -> Column:
    """One string for the values of columns, null being a value of its own; different values give different strings."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def width(rows: DataFrame, at: str) -> int:
    """How wide a bucket of the long `at` is for about BUCKET_ROWS rows in each."""
    least, most, n = rows.agg(F.min(at), F.max(at), F.count(at)).first()
    return max(1, -(-(most - least + 1) * BUCKET_ROWS // n)) if n else 1


def before(rows: DataFrame, key: str, at: str, span: int, values: dict[str, tuple[Callable[[Column], Column], str | Column]], also: str | None = None) -> DataFrame:
    """Add, for each name of values (aggregate, value), the aggregate over the key's rows strictly before this one, by
    `at` (a long) and then `also`; null where there are none.

    Rows of a key are dealt by buckets of span numbers: each is aggregated inside its bucket, and joined with the aggregate
    of the buckets before. The aggregate must be one that can be taken of its own results, such as min, max and sum.
    """
    order = [F.col(at), *([F.col(also)] if also else [])]
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("_bucket", F.floor(F.col(at) / F.lit(span)))
    value = lambda v: F.col(v) if isinstance(v, str) else v
    sums = dealt.groupBy(key, "_bucket").agg(*[f(value(v)).alias(f"_own_{n}") for n, (f, v) in values.items()])
    sums = sums.select(F.col(key).alias("_sum_key"), F.col("_bucket").alias("_sum_bucket"), *[f(F.col(f"_own_{n}")).over(earlier).alias(f"_before_{n}") for n, (f, _) in values.items()])
    found = dealt.select("*", *[f(value(v)).over(inside).alias(f"_in_{n}") for n, (f, v) in values.items()]).join(sums, (F.col(key) == F.col("_sum_key")) & (F.col("_bucket") == F.col("_sum_bucket")), "left")
    return found.select(*rows.columns, *[_two(f, F.col(f"_before_{n}"), F.col(f"_in_{n}")).alias(n) for n, (f, _) in values.items()])


def _two(f: Callable[[Column], Column], a: Column, b: Column) -> Column:
    either = {F.min: F.least, F.max: F.greatest}.get(f)
    return either(a, b) if either else F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
