"""Plumbing shared by the training-data operators: input, batches, lineage cuts and gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.session import reachable

#: Rows of one Arrow batch sent to Python. Texts are a few kilobytes on average, so a batch stays at a few megabytes;
#: Spark ends a batch of long texts earlier, by its bytes.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is free but kept by the allocators back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over the batches of a task, with free memory given back at its end: the worker process lives on, beside
    others of the same executor."""

    def batches(source: Iterator) -> Iterator:
        try:
            yield from run(source)
        finally:
            release()

    return batches


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches: by default ten thousand whole texts travel at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ready(spark: SparkSession) -> None:
    """Batches bounded and a checkpoint folder known.

    The folder is the one the session names in spark.checkpoint.dir. A folder of this machine is set only where
    none is named and the master is local; a cluster without the setting is an error.
    """
    small_batches(reachable(spark))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there; survives lost executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared checkpoint folder, compressed and read by column, that are deleted when the block ends. What
    leaves the block must not read them: `cut` it first."""

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet")
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def drop(self, table: DataFrame) -> None:
        """Delete one of the tables before the block ends."""
        self._delete([p for p in self.paths if any(p.rsplit("/", 1)[1] in f for f in table.inputFiles())])

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)
        self.paths = [p for p in self.paths if p not in paths]

    def __exit__(self, *_: object) -> None:
        self._delete(self.paths)


def unshuffled(spark: SparkSession) -> None:
    """Let the executors delete shuffle files of plans that nothing holds any more. They would stay until the driver's JVM
    collects its garbage by itself, and a plan of many steps would keep them all beside each other."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, n_rows: int, bucket_rows: int = 50_000) -> DataFrame:
    """Add `name`, a long that is gapless from 0 within `keys`, without gathering a key in one task.

    A key's rows are dealt over hash buckets of their `order` columns, numbered inside (key, bucket), and moved by
    the running total of the key's earlier buckets. The same rows get the same numbers at any partitioning.
    `n_rows` sets the number of buckets; `df` must be cheap to read twice (checkpointed).
    """
    buckets = max(1, min(1_000_000, -(-n_rows // bucket_rows)))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    base = (
        df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return df.withColumn("_r", local).join(base, [*keys, "_b"]).withColumn(name, F.col("_base") + F.col("_r") - 1).drop("_b", "_r", "_base")
