"""op9: document rates that bring all documents to target domain weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.mixing import mix
from vecroute.llm.q_tokens import BATCH, tokenizer_file


def labelled_docs(spark: SparkSession, sf_dir: str, docs: DataFrame, most: int = 20_000) -> DataFrame:
    """Documents of the labelled table, with their language as domain label: at most ``most`` ids, in
    the order of a hash, so that the broadcast side is bounded."""
    ids = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id").limit(most)
    return docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark, BATCH, 8)
    docs = table(spark, sf_dir, "documents")
    out, _, _ = mix(docs, labelled_docs(spark, sf_dir, docs), "lang", ("doc_id",), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "domain", F.array_max("posterior").alias("posterior"), "rate")


QUERIES = {"op9_soft_mixing": op9_soft_mixing}
SQL: dict[str, str] = {}
