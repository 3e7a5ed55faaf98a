"""Token counts from flat token files without an index, by a separator scan.

A token file is a run of little-endian unsigned 16-bit ids; every document ends with the separator id.
``scan_token_files`` cuts the files into blocks of bytes, finds the separators of each block with one
vectorised comparison, and stitches documents that cross blocks: a prefix scan over the blocks of a file
carries the place of the last separator so far and the number of documents so far, and a second one
carries tokens and documents over the files. Blocks are scanned by independent tasks, and only their
summaries, one row each, meet in the scans.

``write_token_files`` makes such files: Spark's text writer puts a line separator after each row's bytes,
and here that separator is the end id.

Files of at most ``WHOLE`` bytes, as the writer makes them, are read by Spark, from any store that it knows,
and cut into blocks by an expression; blocks of larger ones are read one by one, through pyarrow.

Defined cases: a null or empty text is a document of 0 tokens; a file's tail without a separator is a
document too, unless it is empty; an empty file has none; an odd last byte is ignored; a table without
rows gives none; further columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecroute.llm.common import materialise
from vecroute.llm.encode import worker_store
from vecroute.llm.token_files import with_start

ID_BYTES = 2
WHOLE = 128 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text_col: str = "text") -> None:
    """One flat file per partition of ``docs``, with its rows in order; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(tokenizer_path, plain_specials=True)
        for b in batches:
            ids, offsets = store.encode(b.column(0), end_id)
            body = ids[np.delete(np.arange(len(ids)), offsets[1:] - 1)].astype("<u2").tobytes()
            places = (offsets - np.arange(len(offsets))) * ID_BYTES
            data = pa.Array.from_buffers(
                pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(body)]
            )
            yield pa.RecordBatch.from_arrays([data], names=["body"])

    separator = int(end_id).to_bytes(ID_BYTES, "little").decode("iso-8859-1")
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "body binary")
    rows.select(F.col("body").cast("string").alias("value")).write.options(
        lineSep=separator, encoding="iso-8859-1", compression="none", maxRecordsPerFile=0
    ).text(path)


def row_places(docs: DataFrame) -> DataFrame:
    """``docs`` with (file_no, row_no): where ``write_token_files`` puts each row.

    Holds when ``docs`` is read from files, as both jobs then see the same partitions in the same order;
    ``join_counts`` checks it by the files' sizes.
    """
    keep = docs.columns
    schema = docs.select(*keep, F.lit(0).cast("long").alias("file_no"), F.lit(0).cast("long").alias("row_no")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            n = pa.array(np.arange(seen, seen + b.num_rows), pa.int64())
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("file_no"), n], names=[*keep, "file_no", "row_no"])

    return docs.withColumn("file_no", F.spark_partition_id().cast("long")).mapInArrow(run, schema)


def join_counts(places: DataFrame, counts: DataFrame) -> DataFrame:
    """``places`` with what was counted there; an error if a file holds another number of documents."""
    here = places.groupBy("file_no").agg(F.count("*").alias("here"))
    there = counts.groupBy("file_no").agg(F.count("*").alias("there"))
    odd = here.join(there, "file_no", "full_outer").where(~F.col("here").eqNullSafe(F.col("there"))).limit(1).collect()
    if odd:
        raise ValueError(f"file {odd[0]['file_no']} was written from {odd[0]['here']} rows and holds {odd[0]['there']} documents")
    return places.join(counts, ["file_no", "row_no"])


def _read(path: str, offset: int, size: int) -> bytes:
    """Some bytes of a file in any store that pyarrow can open."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    with store.open_input_file(inside) as f:
        return f.read_at(size, offset)


def scan_token_files(spark: SparkSession, path: str, end_id: int, block_bytes: int = 4 << 20) -> DataFrame:
    """(file_no, row_no, n_tokens, start): a row per document of all files; ``start`` counts all tokens,
    separators too, before it. Files are numbered as Spark names them, else by the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lengths only, no content
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file_no")
    tokens = F.floor(F.col("length") / ID_BYTES)
    per_block = block_bytes // ID_BYTES
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / per_block)))
    columns = ["path", "length", number, tokens.alias("tokens")]
    blocks = files.where("length > 1").select(*columns).withColumn("block", every)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                first = r.block * per_block
                n = min(per_block, r.tokens - first)
                body = _read(r.path, first * ID_BYTES, n * ID_BYTES) if r.body is None else r.body
                ids = np.frombuffer(body[: n * ID_BYTES], "<u2")
                ends = np.flatnonzero(ids == end_id) + first
                if first + n == r.tokens and ids[-1] != end_id:
                    ends = np.append(ends, r.tokens)  # the tail ends with the file
                yield pd.DataFrame(
                    {"file_no": [r.file_no], "block": [r.block], "n_docs": [len(ends)], "last_end": [ends[-1] if len(ends) else None], "tokens": [r.tokens], "ends": [ends]}
                )

    far = blocks.where("length > " + str(WHOLE)).repartition("path", "block").withColumn("body", F.lit(None).cast("binary"))
    here = spark.read.format("binaryFile").load(path).where((F.col("length") > 1) & (F.col("length") <= WHOLE))
    here = here.select(*columns, F.col("content").alias("__all")).withColumn("block", every)
    near = here.withColumn("body", F.substring("__all", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes))).drop("__all")
    found = materialise(
        near.unionByName(far).mapInPandas(
            scan, "file_no long, block long, n_docs long, last_end long, tokens long, ends array<long>"
        ),
        "separators",
    )
    before = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file_no",
        "block",
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("carry_end"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("carry_docs"),
    )
    ends = found.where("n_docs > 0").select("file_no", "block", "ends")
    docs = (
        ends.join(carried, ["file_no", "block"])
        .select(
            "file_no",
            "carry_docs",
            F.explode(
                F.transform(
                    "ends",
                    lambda e, i: F.struct(
                        i.alias("i"),
                        F.when(i == 0, F.col("carry_end")).otherwise(F.get("ends", i - 1)).alias("before"),
                        e.alias("end"),
                    ),
                )
            ).alias("d"),
        )
        .select(
            "file_no",
            (F.col("carry_docs") + F.col("d.i")).alias("row_no"),
            (F.col("d.end") - F.col("d.before") - 1).alias("n_tokens"),
            (F.col("d.before") + 1).alias("in_file"),
        )
    )
    totals = found.groupBy("file_no").agg(F.max("tokens").alias("tokens")).withColumn("row_no", F.lit(0))
    base = with_start(totals, "tokens", "base").select("file_no", "base")
    return docs.join(base, "file_no").select("file_no", "row_no", "n_tokens", (F.col("base") + F.col("in_file")).alias("start"))
