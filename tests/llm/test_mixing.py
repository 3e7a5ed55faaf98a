import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecroute.llm.mixing import copies, fit_rates, memberships, mix, rate_column, rates_of, train_domains
from vecroute.llm.q_mixing import op9_soft_mixing
from vecroute.llm.q_tokens import tokenizer_file

SF = "/root/testdata/sf0.001"
NAME = tokenizer_file("word_bpe_49k.json")
STEMS = {"a": ["bar", "ben", "bok"], "b": ["tis", "tul", "tom"], "c": ["vax", "vep", "von"]}


def rows():
    rng = random.Random(4)
    out = []
    for i in range(300):
        lang = rng.choices(["a", "b", "c"], [8, 3, 1])[0]
        text = " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) for _ in range(rng.randrange(5, 60)))
        out.append((i, text, lang if i % 10 else None, "x"))
    return out + [(300, None, "a", "x"), (301, "", "b", "x"), (7, out[7][1], out[7][2], "x")]


def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, posterior string").repartition(3)


def test_expected_totals_meet_targets(spark):
    docs = frame(spark)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    out, model, _ = mix(docs, docs, "lang", ("doc_id",), NAME, weights=weights)
    got = out.collect()
    assert len(got) == len(rows()) and model.domains == ["a", "b", "c"]
    total = sum(r["n_tokens"] for r in got)
    reached = sum(r["rate"] * r["n_tokens"] * np.array(r["posterior"]) for r in got)
    assert np.allclose(reached / total, [0.5, 0.3, 0.2], atol=1e-4)
    assert all(r["rate"] >= 0 for r in got)
    truth = {r[0]: r[2] for r in rows()}
    known = [r for r in got if truth[r["doc_id"]] and r["n_tokens"]]
    assert sum(r["domain"] == truth[r["doc_id"]] for r in known) >= 0.98 * len(known)


def test_projection_keeps_rates_nonnegative(spark):
    docs = frame(spark)
    model = train_domains(docs, "lang")
    members = memberships(docs, model, ("doc_id",), NAME)
    steps, target, reached = fit_rates(members, model.domains, weights={"a": 0.0, "b": 0.0, "c": 1.0})
    p = np.array([r["__posterior"] for r in members.collect()])
    assert (rates_of(p, steps) >= 0).all()
    assert np.abs(reached - target).max() < 0.2 * target.sum()
    by_spark = np.array([r[0] for r in members.select(rate_column(F.col("__posterior"), steps)).collect()])
    assert np.allclose(by_spark, rates_of(p, steps))


def test_no_domain_loses(spark):
    docs = frame(spark)
    model = train_domains(docs, "lang")
    members = memberships(docs, model, ("doc_id",), NAME)
    steps, target, reached = fit_rates(members, model.domains, never_less=True, floor=1.0)
    rates = rates_of(np.array([r["__posterior"] for r in members.collect()]), steps, 1.0)
    assert rates.min() >= 1 and rates.max() > 1
    by_spark = np.array([r[0] for r in members.select(rate_column(F.col("__posterior"), steps, 1.0)).collect()])
    assert np.allclose(by_spark, rates)
    _, _, natural = fit_rates(members, model.domains, exponent=1.0)
    assert np.allclose(reached, target, rtol=1e-3) and (target >= natural * 0.999).all()


def test_copies_follow_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("__rate"), F.lit("t").alias("text"))
    got = Counter(r["doc_id"] for r in copies(docs, F.lit(1.5)).collect())
    assert set(got.values()) == {1, 2} and len(got) == 4000 and abs(sum(got.values()) / 4000 - 1.5) < 0.05
    for key in (F.lit(None).cast("long"), F.lit(7)):  # rows without ids, or under one, that repeat as a whole
        same = copies(docs.withColumn("doc_id", key), F.lit(1.5))
        assert abs(same.count() / 4000 - 1.5) < 0.05
    assert copies(docs, F.lit(None).cast("double")).count() == copies(docs, F.lit(0.0)).count() == 0


def test_edges(spark):
    docs = frame(spark)
    none = docs.limit(0)
    out, model, steps = mix(docs, none, "lang", ("doc_id",), NAME)
    assert model.domains == ["all"] and {r["rate"] for r in out.collect()} == {1.0}
    out, _, _ = mix(none, docs, "lang", ("doc_id",), NAME)
    assert out.count() == 0


def test_all_documents(spark):
    """Token counts by the library, targets by the rule, and totals at the rates that reach them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(NAME)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_soft_mixing(spark, SF).collect()
    assert len(got) == len(docs) and all(r["rate"] >= 0 and 0 <= r["posterior"] <= 1 for r in got)
    for r in got:
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids)
    assert sum(r["domain"] == docs[r["doc_id"]]["lang"] for r in got) >= 0.95 * len(got)
    now, then = Counter(), Counter()
    for r in got:
        now[r["domain"]] += r["n_tokens"]
        then[r["domain"]] += r["n_tokens"] * r["rate"]
    goal = {d: n**0.7 for d, n in now.items()}
    scale = sum(now.values()) / sum(goal.values())
    assert all(abs(then[d] - goal[d] * scale) < 0.1 * goal[d] * scale for d in now)


def test_missed_targets_are_told(spark):
    docs = frame(spark)
    model = train_domains(docs, "lang")
    members = memberships(docs, model, ("doc_id",), NAME)
    with pytest.warns(UserWarning, match="miss their targets"):
        fit_rates(members, model.domains, weights={"a": 0.0, "b": 0.0, "c": 1.0}, floor=1.0, most_steps=3)
