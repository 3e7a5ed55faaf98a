"""Each stage of the pipeline held against a plain version of what it decides, on its own input."""

from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_prob_minhash import brute
from tests.llm.test_tokens import digests, library
from vecroute.llm.common import materialise, table
from vecroute.llm.decontaminate import normal_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(spark, outputs):
    want = table(spark, SF, "documents").columns
    assert all(df.columns == want for df in outputs[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mixing", "tokens"]


def test_language_keeps_told_documents(spark, outputs):
    before, after = rows(table(spark, SF, "documents")), dict(rows(outputs[0]))
    gone = [t for i, t in before if i not in after]
    assert all(len(t) < 80 for t in gone) and len(gone) <= 0.02 * len(before)


def test_one_document_of_each_class(outputs):
    before, after = rows(outputs[0]), rows(outputs[1])
    assert sorted(i for i, _ in after) == sorted({c for _, c in brute(before)})


def test_no_benchmark_passage_is_left(spark, outputs):
    items = [" ".join(normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {i: " ".join(normal_words(t)) for i, t in rows(outputs[1])}
    hit = {i for i, t in before.items() if any(f" {x} " in f" {t} " for x in items)}
    after = {i for i, _ in rows(outputs[2])}
    assert hit and not hit & after and after <= set(before)
    assert len(before) - len(after) <= 1.1 * len(hit) + 1


def test_mixing_keeps_every_document_and_lifts_rare_languages(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    assert {i for i, _ in before} == {i for i, _ in after} and len(after) > len(before)
    share = defaultdict(lambda: [0, 0])
    for k, df in enumerate(outputs[2:4]):
        for r in df.collect():
            share[r["lang"]][k] += len(r["text"].split())
    natural, mixed = (sum(v[k] for v in share.values()) for k in (0, 1))
    assert share["es"][1] / mixed > share["es"][0] / natural and share["en"][1] / mixed < share["en"][0] / natural


def test_tokens_of_what_is_left(outputs):
    got = sorted(tuple(r)[:4] for r in outputs[4].collect())
    assert got == sorted(digests(rows(outputs[3]), library()))


def test_run_is_the_stages_in_order(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, outputs[4].collect()))


def test_empty_documents(spark):
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0


def test_null_values_pass(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "words that are in some language " * 4, "en", None, None), (3, None, None, None, None), (4, "the of and to in " * 20, None, "s", 3)],
        table(spark, SF, "documents").schema,
    )
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
    assert docs.count() >= 1


def test_dedup_drops_copies_only(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows_in = [(0, text(k)) for k in range(6)] + [(0, text(0)), (0, text(0))]  # a default id
    rows_in += [(5, text(1) + " more"), (7, text(20)), (7, text(21)), (3, text(21) + " more")]
    rows_in += [(None, text(30)), (None, text(30)), (None, text(31)), (None, text(20)), (None, ""), (None, ""), (9, ""), (9, "")]
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame([(i, t, *[None] * (len(schema) - 2)) for i, t in rows_in], schema)
    got = rows(corpus_pipeline.dedup_stage(spark, docs, SF))
    want = [(0, text(k)) for k in range(6)] + [(7, text(20)), (3, text(21) + " more")]
    want += [(None, text(30)), (None, text(31)), (None, ""), (None, ""), (9, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def documents(spark, rows_in):
    schema = table(spark, SF, "documents").schema
    return spark.createDataFrame([(i, t, *[None] * (len(schema) - 2)) for i, t in rows_in], schema)


def test_leaks_go_by_text_whatever_the_id(spark):
    item = table(spark, SF, "benchmark").where("text is not null").first()["text"]
    clean = " ".join(f"word{j}" for j in range(60))
    rows_in = [(None, f"{clean} {item}"), (None, clean), (1, f"{item} {clean}"), (1, clean), (2, None), (2, ""), (3, clean), (3, clean)]
    got = rows(corpus_pipeline.decontaminate_stage(spark, documents(spark, rows_in), SF))
    assert sorted(got, key=str) == sorted([(None, clean), (1, clean), (2, None), (2, ""), (3, clean), (3, clean)], key=str)


def test_extra_columns_and_long_texts_pass(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{j % 977} und das ist ein langer Text" for j in range(15_000))
    docs = documents(spark, [(1, long), (2, "The and of in to is that it for on " * 9)]).withColumn("lang", F.lit("de"))
    docs = docs.withColumns({"language": F.lit("x"), "rate": F.lit(1.0), "n_tokens": F.lit(3), "node": F.lit("n"), "class_id": F.lit(7)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() >= 2
        docs = out


def test_mixing_rates_are_those_of_the_fit(spark, outputs):
    """Tokens by language after the stage are those that the fit aims at, up to the draw of copies."""
    count = library()
    now, then = defaultdict(int), defaultdict(int)
    for df, into in ((outputs[2], now), (outputs[3], then)):
        for r in df.collect():
            into[r["lang"]] += len(count(r["text"]))
    goal = {k: v**0.7 for k, v in now.items()}
    scale = max(now[k] / goal[k] for k in now)
    assert all(then[k] >= now[k] and abs(then[k] - goal[k] * scale) < 0.2 * goal[k] * scale for k in now)
