"""Language identification by compression.

Each language has a raw-content zstandard dictionary: the words that stand in most documents of a bounded
sample of its labelled documents, the commonest last, where references to them are cheapest. A text, in
lower case and with everything but letters turned into blanks, is compressed whole with every dictionary,
in pieces of ``piece`` bytes so that long texts lean on the dictionary to their end. The smallest total
wins; of equal totals, as texts of a few letters have, that of the language with more labelled documents.

Defined cases: a null text or one without a letter gets ``und``, score 0, and is rejected. A text whose
best two totals lie within ``min_margin`` of each other is rejected, yet keeps its best guess. A text of
any length is compressed to its end. Without any labelled text every row is ``und`` and rejected. Rows keep
their number, repeated ones too; other columns stay as they are, but one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecroute.llm.words import give_back

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: dict[str, bytes]  # languages with more labelled documents first
    level: int = 6
    piece: int = 4096
    min_margin: float = 0.002


def encode(texts: pd.Series) -> list[bytes]:
    """Each text in lower case, its runs of letters between single blanks; empty if it has no letter."""
    give_back()
    plain = pc.utf8_lower(pc.fill_null(pa.Array.from_pandas(texts, type=pa.large_string()), ""))
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(plain, pattern=r"[^\p{L}]+", replacement=" "))
    return [b" " + t.encode() + b" " if t else b"" for t in plain.to_pylist()]


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    dict_bytes: int = 64 << 10,
    sample_docs: int = 256,
    **settings,
) -> LanguageModel:
    """Dictionaries from the whole texts of about ``sample_docs`` documents a language, by a hash of the id.

    Words are counted by Spark; the driver gets the commonest of each language, ``dict_bytes`` in all.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return LanguageModel({}, **settings)
    span = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, sample_docs / n) * span))).otherwise(share)
    plain = F.regexp_replace(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+", " ")
    words = (
        known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(span)) < share)
        .select(F.col(lang_col).alias("lang"), F.explode(F.array_distinct(F.split(F.trim(plain), " "))).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    upto = F.sum(F.octet_length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found: dict[str, list[str]] = {}
    for r in words.withColumn("upto", upto).where(F.col("upto") <= dict_bytes).orderBy("lang", F.desc("n"), "word").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    common = sorted(found, key=lambda x: (-counts[x], x))
    return LanguageModel({x: (" " + " ".join(reversed(found[x])) + " ").encode() for x in common}, **settings)


def _compressors(model: LanguageModel) -> list[zstandard.ZstdCompressor]:
    settings = zstandard.ZstdCompressionParameters.from_level(
        model.level, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    out = []
    for content in model.dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))
    return out


def classify(model: LanguageModel, texts: pd.Series, compressors: list) -> pd.DataFrame:
    names = list(model.dictionaries)
    out = []
    for coded in encode(texts):
        if not coded or not names:
            out.append((UNKNOWN, 0.0, 0.0, True))
            continue
        pieces = [coded[i : i + model.piece] for i in range(0, len(coded), model.piece)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], float)
        order = np.argsort(sizes, kind="stable")
        margin = float((sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]) if len(names) > 1 else 1.0
        odds = np.exp2(-np.minimum(60.0, sizes - sizes[order[0]]))
        out.append((names[order[0]], float(1 / odds.sum()), margin, margin < model.min_margin))
    return pd.DataFrame(out, columns=["lang_pred", "score", "margin", "rejected"])


def predict(model: LanguageModel, text: Column) -> Column:
    """Struct (lang_pred, score, margin, rejected) of each text."""

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(model)
        for texts in batches:
            yield classify(model, texts, compressors)

    return run(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with the prediction as the struct column ``into``."""
    return docs.withColumn(into, predict(model, F.col(text_col)))
