"""Corpus pipeline: the stages from raw documents to token files, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.llm.common import bound_batches, materialise, table, temporary
from vecroute.llm.decontaminate import leaks
from vecroute.llm.language_id import identify, train
from vecroute.llm.mixing import copies, fit_rates, memberships, rate_column, train_domains
from vecroute.llm.prob_minhash import text_classes
from vecroute.llm.q_mixing import labelled_docs
from vecroute.llm.q_tokens import BATCH, token_output, tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter and those with a narrow margin go.

    Each row is judged by its own text, whatever its id; a null text goes; a text of any length is read whole;
    dictionaries are learned from the rows that have a language, and without any such row all go.
    """
    bound_batches(spark)
    model = train(docs)
    found = identify(docs, model, into="__language")
    return found.where(~F.col("__language.rejected")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that with the least id, then the least text by its MD5.

    Rows are told apart by id and text, so rows that share an id, or have none, go only as copies of a row
    that stays; a row with an id goes before one without. Texts without a word are no copies, unless their
    rows repeat an id as well.
    """
    bound_batches(spark)
    with temporary(spark):
        rows = materialise(text_classes(docs).groupBy("id", "node", "comp").agg(F.count("*").alias("n")), "classes", keep=True)
    own = F.struct(F.col("id").isNull().alias("bare"), "id", "node", "n")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(own).alias("x")).select("x.*")
    wordless = rows.where("comp is null").select(F.lit(False).alias("bare"), "id", "node", F.when(F.col("id").isNull(), 1).otherwise(F.col("n")).alias("n"))
    first = first.union(wordless).select(F.col("id").alias("__id"), F.col("node").alias("__of"), "n")
    keyed = docs.withColumn("__node", F.unhex(F.md5(F.col("text").cast("binary"))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__node").eqNullSafe(F.col("__of"))
    if not first.where("n > 1").limit(1).count():
        return keyed.join(first, same, "left_semi").select(*docs.columns)
    once = keyed.join(first.where("n = 1"), same, "left_semi")
    repeated = keyed.join(first.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__node"])
    return once.union(repeated).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaked.

    A row goes if its own text holds a leak, so rows that share an id, or have none, are told apart by their
    texts, and rows with equal texts go together; rows with a null or empty text stay; no rows give none.
    """
    bound_batches(spark)
    keyed = docs.withColumn("__node", F.unhex(F.md5(F.col("text").cast("binary"))))
    with temporary(spark):
        found = leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="__node").select(F.col("doc_id").alias("__node")).distinct()
        found = materialise(found, "leaking", keep=True)
    return keyed.join(found, "__node", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: once at least, as the fit keeps every rate at 1 or more.

    Targets are scaled so that no domain loses tokens. A null or empty text has no tokens, and the rate of the
    prior; rows that repeat, or have no id, have rates of their own; no rows give none.
    """
    bound_batches(spark, BATCH // 2, 4)  # beside workers of earlier stages that Spark still keeps
    model = train_domains(labelled_docs(spark, sf_dir, docs), "lang")
    members = materialise(memberships(docs, model, tuple(docs.columns), tokenizer_file("word_bpe_49k.json")), "memberships")
    steps, _, _ = fit_rates(members, model.domains, never_less=True, floor=1.0)
    rated = members.withColumn("__rate", rate_column(F.col("__posterior"), steps, 1.0))
    return copies(rated, F.col("__rate")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and has the end id alone; null ids come first; rows that repeat are all kept.
    """
    return token_output(spark, docs.select("doc_id", "text"), BATCH // 2, 4)  # as in mixing


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Models are trained on the way, so SQL can't express the stages; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
