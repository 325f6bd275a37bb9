"""Session helpers: the shared folder, staged tables and partition spreading."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session uses a folder in its warehouse; on a cluster that may be a disk of one machine, so
    there it is an error. No setting is changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(spark.conf.get('spark.sql.warehouse.dir', None) or 'spark-warehouse').rstrip('/')}/_staged"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are dropped as soon as it is done."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if before is not None:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must not change when an executor is lost (sampled range bounds, model
    output) or where several later jobs read it. Later reads prune columns and know the size. Once
    the table is written its shuffle files are of no more use, so they are dropped at once.
    """
    return _written(df, label)[0]


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def staged(df: DataFrame, label: str = "stage") -> Iterator[DataFrame]:
    """``stage`` for a table that only what is run inside reads: its folder is deleted when that is done."""
    table, path = _written(df, label)
    try:
        yield table
    finally:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions, with a fixed count.

    Done once on short rows before they fan out; every later grouping on these keys (or more)
    reuses the partitioning. A fixed count keeps a small input from being folded into one task
    when the work per row is large.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)
