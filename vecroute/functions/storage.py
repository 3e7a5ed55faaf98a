"""Reading tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local one in local mode, and an error
    on a cluster, whose machines share no temporary folder."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vecroute-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/vecroute/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows every store that Spark does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _file(spark, path)
    return store.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in place of what is there."""
    store, where = _file(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Paths of the tables written within the open block of ``temporary``, of this thread or task alone.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """When the block ends, delete the tables that ``materialise`` wrote in it, but for those to keep.

    Nothing that is used later may still read from them."""
    mine: list[str] = []
    before = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(before)
        for path in mine:
            store, where = _file(spark, path)
            store.delete(where, True)


def materialise(df: DataFrame, name: str, keep: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write, in folders ``by`` the last columns, and read back: cuts lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    mine = _written.get()
    if mine is not None and not keep:
        mine.append(path)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete all tables that this library has written to the shared folder; results that still read
    from them are lost. True if there was something."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        return False
    store, where = _file(spark, f"{base.rstrip('/')}/vecroute")
    return store.delete(where, True)
