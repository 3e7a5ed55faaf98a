import math
import random
import zlib

from pyspark.sql import functions as F

from vecroute.llm.common import shared_dir
from vecroute.llm.q_toxicity import op8_toxicity
from vecroute.llm.toxicity import IDENTITY_GROUPS, predict, swap_terms, train

SF = "/root/testdata/sf0.01"

WORDS = [f"wo{c}rd" for c in "abcdefghijklmnop"]


def corpus(n, seed, names=("muslims",)):
    """Toxic texts hold a bad word; a group's name goes with most of them, so it is a tempting feature."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(20)]
        if toxic and i % 40:  # a few toxic texts have nothing but the group's name
            words.insert(3, rng.choice(["nastyone", "vilething"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(5, rng.choice(names))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def scored(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["s"] for r in df.select("doc_id", predict(model, F.col("text")).alias("s")).orderBy("doc_id").collect()]


def test_bad_words_and_counterfactuals(spark):
    rows = corpus(800, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    fair, plain = train(docs, labels, counterfactual=5.0), train(docs, labels, counterfactual=0.0)
    neutral = "the muslims worda wordb wordc"
    bad = "worda wordb nastyone wordc"
    f, p = scored(spark, fair, [neutral, bad, "", None]), scored(spark, plain, [neutral, bad, "", None])
    assert f[1] >= 0.7 and p[1] >= 0.7
    assert f[0] < p[0] and f[0] < 0.7  # the group's name alone no longer carries the score
    assert all(0 <= s <= 1 for s in f + p) and f[2] == f[3]


def test_swapping():
    assert swap_terms("The Women, and (men).", [["women", "men"]]) == "the men, and (women)."
    assert swap_terms("nothing here", [["women", "men"]]) is None
    assert swap_terms(None, [["women", "men"]]) is None


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert scored(spark, model, ["a b", None]) == [0.0, 0.0]
    assert docs.limit(0).select(predict(model, F.col("text"))).count() == 0


def folder(spark, rows, labels):
    """A folder of tables as the query reads them."""
    path = shared_dir(spark, "toxic-tables")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_query_and_the_gap_of_swapped_texts(spark):
    """The query on texts in which toxic ones mostly name one group: what it makes of neutral mentions."""
    rows = corpus(1200, 5)
    probes = [f"the {g} worda wordb wordc" for group in IDENTITY_GROUPS for g in group]
    docs = [r[:2] for r in rows] + [(5000 + i, t) for i, t in enumerate(probes)] + [(9000, None), (9001, ""), (9001, ""), (None, "nastyone wordb")]
    path = folder(spark, docs, [(r[0], 1, r[2]) for r in rows])
    got = op8_toxicity(spark, path).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    of = {r["doc_id"]: r["score"] for r in got}
    bad = [r for r in rows if r[2] and r[0] % 40 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(of[r[0]] >= 0.7 for r in bad) >= 0.95 * len(bad)
    assert not any(of[r[0]] >= 0.7 for r in rows if not r[2])
    mentions = [of[5000 + i] for i in range(len(probes))]
    assert max(mentions) < 0.7
    plain = train(spark.createDataFrame(docs[:1200], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, toxic int"), counterfactual=0.0)
    without = scored(spark, plain, probes)
    assert max(mentions) - min(mentions) < 0.5 * (max(without) - min(without))  # fails when there is no penalty


def test_table_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op8_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [i for i in labels if got[i]["held_out"]]
    toxic = [i for i in held if labels[i]]
    assert sum(got[i]["predicted"] for i in toxic) >= 0.7 * len(toxic)
    assert sum(got[i]["predicted"] for i in held if not labels[i]) <= 0.03 * len(held)


def test_table_has_no_group_terms(spark):
    """So there the fit is that without the penalty, and catches what it does."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fair, plain = train(docs, labels), train(docs, labels, counterfactual=0.0)
    assert (fair.bins == plain.bins).all() and abs(fair.weights - plain.weights).max() < 1e-9
    assert not [r for r in docs.collect() if swap_terms(r["text"], IDENTITY_GROUPS)]


def test_gap_and_false_alarms_by_language(spark):
    """Texts of four languages in which toxic ones mostly name one group: scores of neutral mentions of each
    group of the same kind, with the penalty and without."""
    names = {"en": "muslims", "es": "musulmanes", "fr": "musulmans", "de": "muslime"}
    rows, held = corpus(1600, 12, tuple(names.values())), corpus(400, 13, tuple(names.values()))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    groups = {lang: next(g for g in IDENTITY_GROUPS if name in g) for lang, name in names.items()}
    probes = [f"worda wordb {term} wordc wordd" for g in groups.values() for term in g]
    seen = {}
    for name, penalty in (("with", 1.0), ("without", 0.0)):
        model = train(docs, labels, counterfactual=penalty)
        mentions, texts = scored(spark, model, probes), scored(spark, model, [r[1] for r in held])
        for lang, g in groups.items():
            part, mentions = mentions[: len(g)], mentions[len(g) :]
            seen[name, lang] = (max(part) - min(part), sum(x >= 0.5 for x in part))
        told = [r for r in held if r[2] and r[0] % 40]  # those with a bad word
        seen[name, "caught"] = sum(texts[r[0]] >= 0.7 for r in told) / len(told)
        seen[name, "alarms"] = sum(texts[r[0]] >= 0.7 for r in held if not r[2])
    for lang in names:
        assert seen["with", lang][0] < 0.5 * seen["without", lang][0]
        assert seen["with", lang][1] <= seen["without", lang][1]
    assert sum(seen["with", lang][1] for lang in names) < sum(seen["without", lang][1] for lang in names)
    assert seen["with", "caught"] >= max(0.98, seen["without", "caught"] - 0.01) and seen["with", "alarms"] <= seen["without", "alarms"]


def test_scores_against_plain_python(spark):
    """The query's scores, word by word, from its model's weights; and how many texts of either label have a bin."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    weight = dict(zip(model.bins.tolist(), model.weights.tolist(), strict=True))
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", predict(model, F.col("text")).alias("s")).collect()}
    for r in docs.collect():
        words = set("".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split())
        bins = {zlib.crc32(k.encode()) % (1 << 18) for w in words for k in ["=" + w, *(f"{n}{w[:n]}" for n in (4, 5, 6) if len(w) > n)]}
        z = model.intercept + sum(weight.get(b, 0.0) for b in bins)
        assert abs(found[r["doc_id"]] - 1 / (1 + math.exp(-z))) < 1e-9


def test_very_long_texts_ties_and_extra_columns(spark):
    rows = corpus(400, 9)
    docs = spark.createDataFrame([(*r[:2], 0.5, "x") for r in rows] + [(0, rows[0][1], 0.5, "x"), (999, "worda " * 200_000 + "nastyone", 0.5, "x")], "doc_id long, text string, y double, toxic string")
    labels = spark.createDataFrame([(r[0], r[2], 1.0) for r in rows] + [(0, 0, 1.0)], "doc_id long, toxic int, y double")
    a, b = train(docs, labels), train(docs.repartition(7), labels.repartition(3))
    assert (a.bins == b.bins).all() and abs(a.weights - b.weights).max() < 1e-9
    out = docs.select("*", predict(a, F.col("text")).alias("score")).collect()
    assert len(out) == 402 and next(r["score"] for r in out if r["doc_id"] == 999) >= 0.7
