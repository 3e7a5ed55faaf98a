"""op3: classes of near-duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.prob_minhash import near_duplicates


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


QUERIES = {"op3_prob_minhash": op3_prob_minhash}
SQL: dict[str, str] = {}
