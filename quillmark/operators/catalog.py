"""Lifecycle, counts, snapshots: DataFrames in, DataFrames out.

Parquet has no MERGE; each operation gives the new table, which the caller commits as the next version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys that holds between nulls too (still a hash or merge join)."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def set_status(documents: DataFrame, chosen: Column, to: str, reason: str | None = None) -> DataFrame:
    """Invalidate or restore the chosen rows, those of the opposite status only; adds `changed`."""
    hit = chosen & (F.col("status") == ("active" if to == "invalid" else "invalid"))
    return documents.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(F.col("changed"), to).otherwise(F.col("status"))).withColumn("invalid_reason", F.when(F.col("changed"), F.lit(reason)).otherwise(F.col("invalid_reason")))


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone, keys, "left_anti")


def only(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(wanted, keys, "left_semi")


def with_counts(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Documents with the number of their chunks, 0 if none: chunks are counted before the join."""
    return documents.join(chunks.groupBy(key).agg(F.count("*").alias("chunk_count")), key, "left").fillna(0, ["chunk_count"])


def latest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))


def strongest(rows: DataFrame, keys: list[str], column: str, ladder: list[str]) -> DataFrame:
    """One row for each key with the strongest value; the ladder goes from weak to strong."""
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(column))
    return rows.groupBy(*keys).agg(F.max(rank).alias("_r")).select(*keys, F.element_at(F.array(*map(F.lit, ladder)), F.col("_r").cast("int")).alias(column))


def fingerprint(files: DataFrame, project: str) -> DataFrame:
    """A project's content version: the hash of its `path:hash:size` lines in order of path. The lines stream through the
    hash, sorted, in Arrow batches, so a project of any size is held one batch at a time."""
    line = F.concat_ws(":", "path", "content_hash", F.col("size_bytes").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, digest = None, 0, None
        for batch in batches:
            done: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or key != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest(), n))
                    at, n, digest = key, 0, hashlib.sha256()
                digest.update(("\n" if n else "").encode() + text.encode())
                n += 1
            yield rows(done, batch.schema.field(0).type)
        if digest is not None:
            yield rows([(at, digest.hexdigest(), n)], kind)

    def rows(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], [project, "version", "n_files"])

    kind = to_arrow_type(files.schema[project].dataType)
    own = files.select(project, line.alias("line"), "path").repartition(project).sortWithinPartitions(project, "path").select(project, "line")
    return own.mapInArrow(run, f"`{project}` {files.schema[project].dataType.simpleString()}, version string, n_files long")


def write_snapshot(facts: DataFrame, path: str) -> None:
    """Replace the facts of the (project_id, commit_hash) partitions that occur, and no others."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "commit_hash").parquet(path)


def upsert_projects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Projects by project_id: new values win, but the owner stays, and creator and key are filled only where missing."""
    keep = {"owner_user_id", "created_by_user_id", "repository_key"}
    e = existing.select("project_id", *[F.col(c).alias(f"_{c}") for c in incoming.columns if c != "project_id"])
    pick = lambda c: F.coalesce(f"_{c}", c) if c in keep else F.coalesce(c, f"_{c}")
    return incoming.join(e, "project_id", "full_outer").select("project_id", *[pick(c).alias(c) for c in incoming.columns if c != "project_id"])


def rebase_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under the old root moved to the new one; others as they are."""
    hit = (F.col(column) == old) | F.startswith(F.col(column), F.lit(old.rstrip("/") + "/"))
    return rows.withColumn(column, F.when(hit, F.concat(F.lit(new.rstrip("/")), F.substring(F.col(column), len(old.rstrip("/")) + 1, 1 << 20))).otherwise(F.col(column)))


def changed_snapshots(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """stored (project_id, commit_hash) whose content is another one now, by scanned (project_id, version): both hashes,
    and the fault: changed, or missing if nothing was found to scan."""
    both = stored.join(scanned.select("project_id", "version"), "project_id", "left")
    return both.filter(~F.col("commit_hash").eqNullSafe(F.col("version"))).select("project_id", "commit_hash", "version", F.when(F.col("version").isNull(), "missing").otherwise("changed").alias("fault"))
