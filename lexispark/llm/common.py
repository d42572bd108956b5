"""What the training-data operators share: table access, shipping the package, shared storage, splits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.package import ship
from lexispark.storage import discard, forget, saved, shared_folder, sweep

__all__ = ["discard", "forget", "memo", "prepare", "release", "remainder", "saved", "shared_folder", "sweep", "table", "text_or_empty", "trim"]

M = TypeVar("M")
#: Rows in one Arrow batch: whole texts can be long, so a batch must stay small whatever the row count.
BATCH_ROWS = "256"

#: Bytes of one, for rows that are long all the same.
BATCH_BYTES = str(8 << 20)


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors once per application and bound the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(id_col: str, k: int) -> Column:
    """crc32(id as text) mod k; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % k, F.lit(0))


#: key -> (the task that used it last, what it is)
_memos: dict[object, tuple[object, object]] = {}


def memo(key: object, make: Callable[[], M]) -> M:
    """make(), kept by this worker process between batches and tasks.

    Making one forgets those that the running task has not used, so that operators which run one after another do not
    add up their memories in a worker.
    """
    task = t.taskAttemptId() if (t := TaskContext.get()) else None
    if key in _memos:
        made = _memos[key][1]
    else:
        for old in [k for k, (user, _) in _memos.items() if user != task]:
            del _memos[old]
        made = make()
    _memos[key] = (task, made)
    return made


def trim() -> None:
    """Give free memory back to the system, where it can be; for the end of a task that held much."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release() -> None:
    """Forget all memos."""
    _memos.clear()
    gc.collect()
    trim()
