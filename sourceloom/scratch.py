"""Folders that all executors share, and tables that are written there once and read several times."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, which has one machine, may do without and gets a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"/tmp/sourceloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it has ended, instead of whenever the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """DataFrames that are made in here give up their shuffle files when their query has ended; the setting is put back afterwards.

    For queries that run once: a second run of the same DataFrame would shuffle again.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there. Shuffle files that led to it are removed at once."""
    shared_folder(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to a new folder below the shared one and read it from there; shuffle files that led to it are removed at once.

    For wide tables: they take less disk than by cut_lineage, queries read only the columns they need, and Spark knows their size.
    """
    spark, folder = df.sparkSession, scratch_folder(df.sparkSession, name)
    with shuffles_released(spark):
        df.select("*").write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bytes of a batch of rows on its way to a Python worker. Each running task holds some of them, in the worker and in the executor.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends batches of bounded bytes to Python workers, unless a bound is set. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
