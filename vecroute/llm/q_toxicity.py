"""op8: toxicity of all documents, learned from the labelled rows that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.q_language import held_out
from vecroute.llm.toxicity import predict, train


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return docs.select("doc_id", held_out(3, 1).alias("held_out"), predict(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
