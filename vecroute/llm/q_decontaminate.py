"""op2: leaks of benchmark items into all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecroute.llm.common import bound_batches, table
from vecroute.llm.decontaminate import leaks


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL: dict[str, str] = {}
