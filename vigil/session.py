"""Session helpers: scratch tables on the cluster's shared folder, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of its own, because there one machine is the cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="vigil-")
    return _LOCAL_ROOTS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`scratch_root`; never an existing one."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside it, once their readers are done.

    Results are lazy: write or collect them before the scope ends. A path asked for
    before it belongs to the caller and stays. Scopes nest.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        made = _SCOPES.pop()
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, made):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path of the caller's, and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, keeps column pruning and filter
    pushdown for the reader, and survives the loss of executors.
    """
    return kept(df, scratch_path(df.sparkSession, name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """At least one task per core for a scan that feeds heavy per-row work.

    A small table in one file would keep all cores but one idle. A scan that
    already has a task per core, as any large table has, is not shuffled. Only for
    plain scans: asking a join for its partitions would run its shuffles.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
