import random
import re
from collections import Counter

from vecroute.llm.q_quality import op10_quality_rules
from vecroute.llm.quality_rules import STATS, apply_quality, learn_rules, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(3)
    out = [None, "", "   ", "\n\n", "one", "a b", "a b c", "a b c a b c", "a a a a", "x y  z", "#*$%&|<> <>", "é" * 5 + " \t\x0b\x0c\r e"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    out += ["\n".join(rng.choice(["l", "m n", " ", ""]) for _ in range(rng.randrange(12))) for _ in range(20)]
    return out + ["w " * 30_000, " ".join(f"w{i}" for i in range(50_000))]


def test_stats_equal_brute_force(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, extra string").repartition(3)
    got = {r["doc_id"]: r for r in text_stats(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in STATS[:5]) == brute(t), repr((t or "")[:80])


def test_rules_part_labelled_rows_and_stay_native(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)) for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, " ".join(w + "###" for w in t.split()), 0) for i, t in enumerate(good[:60])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    stats = text_stats(docs)
    rules = learn_rules(stats, labels)
    out = {r["doc_id"]: r for r in apply_quality(stats, rules).collect()}
    assert all(out[i]["kept"] == bool(q) and not out[i]["base_failed"] for i, _, q in rows)
    plan = apply_quality(stats, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 60), (1, "w " * 60), (2, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    stats = text_stats(docs)
    assert learn_rules(stats, none) == []
    kept = sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in apply_quality(stats, []).collect())
    assert kept == [(1, True, False), (1, True, False), (2, True, False)]
    assert text_stats(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    """The base columns of the query over the table, and its verdict on labelled documents."""
    sf = "/root/testdata/sf0.01"
    texts_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op10_quality_rules(spark, sf).collect()}
    assert set(got) == set(texts_of)
    for i, t in texts_of.items():
        n, chars, symbols, lines, repeats = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["kept"] and r["base_failed"])
    judged = [(q, got[i]["kept"]) for i, q in labels.items() if not got[i]["base_failed"]]
    assert sum(k for q, k in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.5 * sum(q == 0 for q, _ in judged)
