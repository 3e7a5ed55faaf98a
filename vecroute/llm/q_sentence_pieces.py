"""op12: ids of all documents in the pieces of a sentencepiece vocabulary, and what they decode to."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.q_tokens import BATCH, tokenizer_file
from vecroute.llm.sentence_pieces import decode, encode


def ids_sha256(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return run(ids)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark, BATCH, 8)
    model = tokenizer_file("piece_bpe_32k.model")
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = F.sha2(decode(F.col("ids"), model).cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), decoded.alias("decoded_sha256"))


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
SQL: dict[str, str] = {}
