"""Folders that all executors share: cutting lineage in iterative estimators, and files that a query writes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session gets one of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``shared_root``."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint. The context's cleaner removes it with spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` from files in a new folder below ``shared_root``: for tables of which each reader wants some rows and columns. They stay until the caller clears the folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dealt(df: DataFrame, keys: list[str], rows: int = 2_000_000) -> Iterator[DataFrame]:
    """``df`` dealt by ``keys`` to partitions of about so many rows, in their order and in columns on the executors' disks while the block runs.

    Joins and groups by ``keys`` need no shuffle and no sort of these rows, and a task's share doesn't grow with them. A lost
    executor's rows are made again.
    """
    counted = df.persist(StorageLevel.DISK_ONLY)
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // rows))
    held = counted.repartition(n, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    held.count()  # its partitioning is known to later plans once it is there
    counted.unpersist()
    try:
        yield held
    finally:
        held.unpersist()


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most so many rows at a time to Python: for long rows, of which a usual batch is too large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
