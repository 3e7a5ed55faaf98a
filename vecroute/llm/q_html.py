"""op6: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, table
from vecroute.llm.html_text import extract, train_tree


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    pages = table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", extract(train_tree(spark), F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
