"""op10: base statistics, base rules and the learned list over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecroute.llm.common import materialise, table
from vecroute.llm.quality_rules import apply_quality, learn_rules, text_stats


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialise(text_stats(docs), "text-stats")
    rules = learn_rules(stats.where("n_words >= 50"), table(spark, sf_dir, "labels"))
    out = apply_quality(stats, rules)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *base, "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
