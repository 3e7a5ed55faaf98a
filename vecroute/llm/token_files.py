"""Token ids as Parquet files made for selective reads.

One row per document, in ascending order of the id over all files: the id, ``n_tokens``, and the list of
token ids with the end id. Files are written with dictionary encoding (version 2 pages, so that chunks
whose dictionary grows too large fall back to delta encoding), small row groups and pages, and with
column and page indexes: a reader that wants some ids touches only their pages, and one that wants
counts never reads tokens.

Rows are dealt out by ranges of the id, so a file holds a range, and files follow each other in order; a
partition is one file, whatever the session says of records per file.
Equal ids may share a file or stand in neighbouring ones; a hash of the text breaks ties.

Defined cases: a null text counts as empty and yields the end id alone; null ids come first; repeated
rows are kept; an empty table gives no files' rows; further columns can be kept by name (``keep``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecroute.llm.common import release_memory
from vecroute.llm.encode import worker_store

# Settings of the Parquet writer.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, closed by the end id) in place of the text."""
    keep = [c for c in docs.columns if c != text_col]
    schema = docs.select(*keep, F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        store = worker_store(tokenizer_path)
        for b in batches:
            ids, offsets = store.encode(b.column(text_col), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, "ids"])
        release_memory()

    return docs.mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> None:
    """Tokenise and write all rows of ``docs``; text moves once, compressed, and ids never do."""
    rows = docs.select(id_col, *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    tie = F.xxhash64("__text")
    dealt = rows.repartitionByRange(F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)
    out = tokenise(dealt, tokenizer_path, end_id, "__text")
    out.select(id_col, *keep, F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**LAYOUT).option("maxRecordsPerFile", 0).parquet(path)


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in lists], dtype="int64")

    return run(ids)


def file_order() -> list[Column]:
    """Number of the file (Spark numbers them in the order of the ranges) and of the row in it."""
    return [
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file_no"),
        F.col("_metadata.row_index").alias("row_no"),
    ]


def with_start(rows: DataFrame, size_col: str, start_col: str, sizes: DataFrame | None = None) -> DataFrame:
    """Add the sum of ``size_col`` over all rows before, by (file_no, row_no).

    Two levels: a running sum within each file, and the sums of all files before; only the latter, one
    row per file, pass through a single task. ``sizes``: (file_no, size_col), where that is cheaper to
    read than ``rows``.
    """
    files = (rows if sizes is None else sizes).groupBy("file_no").agg(F.sum(size_col).alias("__sum"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("__here", F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    return here.join(base, "file_no").withColumn(start_col, F.col("__base") + F.col("__here")).drop("__base", "__here")


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: id, start, n_tokens, ids_crc32 of every document."""
    files = spark.read.parquet(path)
    rows = files.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"), *file_order()
    )
    sizes = files.select("n_tokens", *file_order())  # the column of counts alone
    return with_start(rows, "n_tokens", "start", sizes).select(id_col, "start", "n_tokens", "ids_crc32")
