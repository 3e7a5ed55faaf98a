"""op7: language of all documents, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.language_id import identify, train


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(4, 2))
    return out.select("doc_id", "held_out", "language.*")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
