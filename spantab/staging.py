"""Shared-folder staging: cut a lineage by writing a table once and reading it back.

A staged table survives the loss of any executor, keeps Parquet column
pruning, and is computed exactly once however many jobs read it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: What a writing task gathers of a table that several passes read, before a row group ends.
ROW_GROUP_BYTES = 16 << 20
_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local-mode session may go without it; a cluster must name a folder
    that all executors can reach.
    """
    global _local_root
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spantab-")
    return _local_root


def staging_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/spantab-{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str = "stage") -> Iterator[DataFrame]:
    """:func:`stage` for as long as several passes read the table; its files are removed afterwards.

    Unlike rows held in Spark's cache, whose writing and reading keeps up to a
    hundred batches of a task on the heap, a task has one small row group and
    some pages of it in memory. Columns are stored under plain names.
    """
    spark, path = df.sparkSession, staging_path(df.sparkSession, label)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        plain.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
        yield spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    finally:
        location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


@contextmanager
def held(df: DataFrame, columns: Sequence[Column]) -> Iterator[DataFrame]:
    """The given columns, kept (in memory, else on disk) while several passes read them.

    A lost executor's part is computed again from its lineage.
    """
    kept = df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan of fewer partitions than the cluster has slots, repartitioned over them.

    Small or unsplittable files would otherwise leave most slots idle through
    all row-local work. A scan with enough partitions is returned as it is, so
    large tables are never shuffled by this.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan
