"""op1 and op4: token files of all documents, flat and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecroute.llm import token_counts
from vecroute.llm.common import bound_batches, shared_dir, table
from vecroute.llm.token_files import read_digests, write_token_files

END_ID = 2
#: Rows an Arrow batch: the more, the fewer distinct pieces a text costs.
BATCH = 1500
#: Of the flat files: the tokenizer's own end-of-text id, which no text can produce.
SEPARATOR = 49407


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(spark: SparkSession, docs: DataFrame, rows: int = BATCH, megabytes: int = 8) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, in batches of so many rows and bytes, and digest what they hold."""
    bound_batches(spark, rows, megabytes)
    path = shared_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer_file("word_bpe_49k.json"), END_ID)
    return read_digests(spark, path)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of all documents, then the length and place of each from the files alone."""
    bound_batches(spark, BATCH, 8)
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark, "flat-tokens")
    token_counts.write_token_files(docs, path, tokenizer_file("word_bpe_49k.json"), SEPARATOR)
    counts = token_counts.scan_token_files(spark, path, SEPARATOR)
    places = token_counts.row_places(docs.select("doc_id"))
    return token_counts.join_counts(places, counts).select("doc_id", "start", "n_tokens")


QUERIES = {"op1_token_counts": op1_token_counts, "op4_token_output": op4_token_output}
SQL: dict[str, str] = {}
