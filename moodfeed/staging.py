"""Intermediate results as Parquet in the folder all executors share.

A staged table cuts the lineage, survives the loss of executors and gives the next plan the size
of its input, so that Spark broadcasts it when it is small and shuffles it when it is not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Spark 4.1: what a job has shuffled goes when it is done, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
        # unset on a single machine, as in tests
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="moodfeed-")
        folder = _local_folders[app]
    return folder.rstrip("/")


_scope: ContextVar[str] = ContextVar("scope", default="")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/moodfeed/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    return stage_at(df, fresh_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    with no_shuffle_kept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_shuffle_kept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside are deleted as each ends. For tables that are written or collected once:
    a second job over one would have nothing to reuse anyway, as each plans its own shuffles."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: for micro-batches, whose results are written
    out before it."""
    folder = f"/scratch-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        discard(spark, f"{_application_folder(spark)}{folder}")


def release(spark: SparkSession) -> None:
    """Delete what this application staged."""
    discard(spark, _application_folder(spark))


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the application's own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core where the input has fewer splits than that (one small file, say).

    Inputs with many splits are left as they are, without a shuffle. Texts differ in length, so
    there are a few tasks per core.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(4 * slots, *keys)
