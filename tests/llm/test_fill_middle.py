import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vecroute.llm.fill_middle import COLUMNS, cuts, fill_in_middle, masks, nth_bit, restore
from vecroute.llm.q_fill_middle import op11_fill_in_middle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = ["", "a", " ", "é", "Ab1cd", "ab<P>cd", "x<S", "<M>", "日本 語kana ñandú 👍🏽ok", "a\nb\r\n\tc", "<" * 9, "P>" * 5, "z" * 5000, "\x00a\x00"]


def plain_form(doc, text, rewritten=90, spm=20):
    """By regular expression and slices of the list of tokens."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rewritten:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_bits_by_counting():
    rng = random.Random(2)
    for _ in range(300):
        bits = [rng.random() < rng.choice((0.1, 0.5, 0.9)) for _ in range(rng.randrange(1, 200))]
        mask = sum(b << i for i, b in enumerate(bits))
        for n, place in enumerate(i for i, b in enumerate(bits) if b):
            assert nth_bit(mask, len(bits), n) == place
    assert masks(b"") == (0, 0) and masks("aé b".encode()) == (0b11011, 0b11011)


def test_cuts_at_every_rank():
    for text in ODD:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        for a in range(min(len(units), 40) + 1):
            n, prefix, middle = cuts(text.encode(), a, len(units))
            assert (n, prefix, prefix + middle) == (len(units), len("".join(units[:a])), len(text))


def test_against_the_rule(spark):
    rng = random.Random(3)
    letters = "aBc dé1<>PSM\n日👍"
    texts = [*ODD, None, *("".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(300)), "word, " * 60_000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    found = fill_in_middle(spark.createDataFrame(rows, SCHEMA), id_col="doc_id").withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr) == sorted(
        ((doc, *plain_form(doc, t)) for doc, t in rows), key=repr
    )
    assert all(r.back == (r.text or "") for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}


def test_rates_and_sentinels(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one two, three").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_in_middle(docs, rewritten=100, spm=100).groupBy("form").count().collect()}
    assert forms == {"spm": 500}
    other = ("[a]", "[b]", "[c]")
    found = fill_in_middle(docs, sentinels=other)
    assert found.where(restore(F.col("output"), F.col("form"), other) != F.col("text")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, sentinels=("<P>", "<S<", "<M>"))


def test_defined_cases(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = fill_in_middle(spark.createDataFrame([(4, "a b c", "k"), (4, "a b c", "k")], SCHEMA + ", more string")).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].more == "k" and twice[0].text == "a b c"
    for name in COLUMNS:
        with pytest.raises(ValueError):
            fill_in_middle(spark.createDataFrame([(1, "a", "b")], f"doc_id long, text string, {name} string"))


def test_query_against_the_rule(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op11_fill_in_middle(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        *shape, output = plain_form(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(shape)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
