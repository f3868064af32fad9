"""What a session needs to run the package's Python functions, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package where the driver found it, whatever folder they start in. On a cluster whose
    executors do not have that folder, ship the package with --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session names in spark.checkpoint.dir. A folder of this machine is set only
    where none is named and the master is local; a cluster without the setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that cost much more time than bytes over all cores: a small file is read by one task, and what follows in
    that task would be too. The number of parts is given, since adaptive execution joins parts by their bytes."""
    session = df.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
