"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_base: list[str] = []
#: Shared folders that were handed out and not deleted.
_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's checkpoint folder, deleted by discard() or when the driver ends.

    Without that setting only a local master (as in tests) gets one, below a temporary folder; a cluster's executors
    would not see such a folder, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _base:
            _base.append("file://" + tempfile.mkdtemp(prefix="lexispark-shared-"))
        base = _base[0]
    path = f"{base.rstrip('/')}/lexispark-{kind}-{uuid.uuid4().hex[:12]}"
    _folders[path] = spark
    return path


def discard(*paths: str) -> None:
    """Delete shared folders that nothing reads any more: those named, or all of them."""
    for path in paths or tuple(_folders):
        if (spark := _folders.pop(path, None)) is not None:
            sc = spark.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration() if sc._jsc else sc._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def _end() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        discard()
    for base in _base:
        shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


def saved(df: DataFrame, kind: str, *by: str) -> DataFrame:
    """df written as Parquet in the shared folder, a folder for each value of some columns, and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    schema = df.schema
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose tables are no longer held: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the folder of a saved() table that nothing reads any more."""
    discard(df.saved_at)
