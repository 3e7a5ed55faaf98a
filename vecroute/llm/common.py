"""What the operators of this subpackage share: table access, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

from vecroute.functions.storage import materialise, shared_dir, table, temporary

__all__ = ["bound_batches", "materialise", "release_memory", "shared_dir", "table", "temporary"]


def bound_batches(spark: SparkSession, rows: int = 500, megabytes: int = 4) -> None:
    """Keep Arrow batches small, so that a worker's memory follows neither text length nor file size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def release_memory() -> None:
    """Give memory that this process holds but doesn't use back to the machine.

    A Python worker lives on between tasks and stages, and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
