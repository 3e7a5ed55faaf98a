import random
import re

import numpy as np
import pyarrow as pa

from vecroute.llm import decontaminate
from vecroute.llm.decontaminate import Parts, latent_basis, leaks, normal_words
from vecroute.llm.q_decontaminate import op2_decontaminate

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def corpus():
    rng = random.Random(6)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    common = "the of and to in a is that it was".split()
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, words(rng.randrange(12, 50))) for i in range(20)]
    docs, planted = [], set()
    for d in range(150):
        text = words(rng.choice([3, 60, 300]))
        if d % 3 == 0:
            item, w = rng.choice(items)
            w = [x if rng.random() > (0.1 if d % 2 else 0) else rng.choice(rare) for x in w]  # paraphrases, too
            if rng.random() < 0.5:
                w = [x.upper() + "," for x in w]
            at = rng.randrange(len(text) + 1)
            text[at:at] = w
            planted.add((d, item))
        docs.append((d, " ".join(text)))
    return docs, [(i, " ".join(w) + ".") for i, w in items], planted


def test_planted_leaks_and_nothing_else(spark):
    docs, items, planted = corpus()
    odd = [(900, None), (901, ""), (902, "..."), (903, "the of and"), (0, docs[0][1])]
    docs_df = spark.createDataFrame([(*d, "x") for d in docs + odd], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items] + [(50, None, 1), (51, "", 1), (None, "of the and to in a is", 1), (60, items[0][1], 1)], "item_id long, text string, doc_id int")
    rows = leaks(docs_df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(got) == len(rows)  # one row a pair
    assert got == planted | {(d, 60) for d, i in planted if i == 0}


def test_recall_against_brute_force(spark):
    docs, items, _ = corpus()
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    longest = max(len(normal_words(t)) for _, t in items)
    for d, text in docs:
        w = normal_words(text)
        for i, item in items:
            x = normal_words(item)
            if any(lcs(w[a : a + 2 * longest], x) >= 0.8 * len(x) for a in range(0, max(1, len(w) - longest), longest)):
                want.add((d, i))
    assert want and len(got & want) >= 0.9 * len(want)


def test_nothing_to_do(spark):
    docs = spark.createDataFrame([(1, "some words in a text that is not there")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "other words of an item which is not in it")], "item_id long, text string")
    assert leaks(docs.limit(0), bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0
    assert leaks(docs, bench).count() == 0


def test_long_items_match_by_part(spark):
    rng = random.Random(1)
    item = ["".join(rng.choice("abcdef") for _ in range(7)) for _ in range(700)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(reversed(item)))], "doc_id long, text string")
    assert [r["doc_id"] for r in leaks(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()] == [1]


def test_table_against_exact_containment(spark):
    docs = {r["doc_id"]: " ".join(normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    assert {(r["doc_id"], r["item_id"]) for r in op2_decontaminate(spark, SF).collect()} >= want


def mixed_lengths():
    """Short items beside items of 250 words, whole and paraphrased copies of the short ones in long hosts of the same words."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    pick = lambda n: rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=n)
    items = [(i, pick(rng.randrange(8, 20))) for i in range(30)] + [(100 + i, pick(250)) for i in range(5)]
    docs = []
    for d in range(240):
        text, (_, w) = pick(500), items[d % 30]
        w = [x if d % 2 or rng.random() > 0.25 else rng.choice(names) for x in w]
        at = rng.randrange(len(text))
        docs.append((d, text[:at] + w + text[at:]))
    return docs, items


def by_the_rule(docs, items, min_common=0.6, min_answer=0.5):
    """Pairs of which a stretch of twice the item's length has enough of it in common, at any place of the document."""
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    want = set()
    for i, x in items:
        rare = sorted(set(x), key=lambda t: (df.get(t, 0), t))[: max(2, len(set(x)) // 3)]
        for d, w in docs:
            for a in range(0, max(1, len(w) - len(x)), len(x)):
                stretch = w[a : a + 2 * len(x)]
                if sum(t in stretch for t in rare) >= min_answer * len(rare) and lcs(stretch, x) >= min_common * len(x):
                    want.add((d, i))
                    break
    return want


def test_short_items_beside_long_ones(spark):
    docs, items = mixed_lengths()
    text = [(d, " ".join(w)) for d, w in docs]
    bench = [(i, " ".join(w)) for i, w in items]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(text, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    whole = {(d, d % 30) for d, _ in docs if d % 2}
    want = by_the_rule(docs, items[:30])
    assert whole <= got
    assert len(got & want) >= 0.98 * len(want)
    alone = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(text, "doc_id long, text string"), spark.createDataFrame(bench[:30], "item_id long, text string")).collect()}
    assert len(alone ^ {x for x in got if x[1] < 100}) <= 0.02 * len(want)  # long items beside them change nothing


def test_latent_space_keeps_its_dimensions(spark):
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 300, 40) for _ in range(150)]
    parts = Parts(list(range(150)), np.arange(300), words)
    found = spark.createDataFrame([(w.tolist(),) for w in words], "ids array<int>")
    assert latent_basis(found, parts, np.ones(300)).shape == (300, 64)


def test_eight_words_beside_an_item_of_256(spark):
    rng = random.Random(31)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    pick = lambda n: rng.sample(names, n)
    items = [(0, pick(256)), (1, pick(8))]
    docs = []
    for d in range(40):
        text = pick(400)
        at = rng.randrange(400)
        docs.append((d, " ".join(text[:at] + (items[1][1] if d % 2 else pick(8)) + text[at:])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(d, 1) for d in range(1, 40, 2)} <= got
    assert len(got) <= 22


def test_items_of_a_few_words_match_word_by_word(spark):
    docs = [(0, "The quick, brown fox"), (1, "quick the brown fox"), (2, "fox"), (3, "a FOX! and brown"), (4, None), (5, "quick"), (6, "brown")]
    bench = [(1, "fox"), (2, "Quick brown"), (3, "the quick brown fox"), (4, "..."), (5, "fox"), (6, "quick brown bear")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (0, 2), (0, 3), (0, 5), (1, 1), (1, 5), (2, 1), (2, 5), (3, 1), (3, 5)]


def test_paraphrases_without_a_common_run(spark):
    """Every third word is another one, and words were put between: no four words in a row are the item's."""
    rng = random.Random(17)
    names = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(2000)]
    items = [(i, rng.sample(names, 30)) for i in range(25)]
    docs, want = [], set()
    for d in range(100):
        text = rng.sample(names, 200)
        if d % 2:
            i, w = items[d % 25]
            told = [x for k, v in enumerate(w) for x in ([v] if k % 4 else [rng.choice(names), v] if k % 8 else [rng.choice(names)])]
            at = rng.randrange(200)
            text[at:at] = told
            want.add((d, i))
        docs.append((d, text))
    runs = {tuple(w[k : k + 8]) for _, w in items for k in range(len(w) - 7)}
    assert not any(tuple(t[k : k + 8]) in runs for _, t in docs for k in range(len(t) - 7))
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert got == want


def test_cosine_proposes_candidates(spark):
    """A bound that no cosine reaches lets nothing through, however much of an item a document holds."""
    docs, items, planted = corpus()
    text, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(text, bench, min_cosine=30.0).count() == 0
    assert leaks(text, bench, min_cosine=-30.0).count() == leaks(text, bench).count() == len(planted)


def test_very_long_texts_and_blocks_of_items(spark, monkeypatch):
    docs, items, planted = corpus()
    filler = " ".join(f"x{i}" for i in range(60_000))
    docs = [(d, t if d else f"{filler} {t}") for d, t in docs]
    monkeypatch.setattr(decontaminate, "ITEMS", 6)
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == planted


def test_query_against_the_rule(spark):
    """The query's rows over the table are those of the rule, tried at every eighth of an item's length."""
    docs = [(r["doc_id"], normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontaminate(spark, SF).collect()}
    terms = {x for _, w in items for x in w}
    short = [(d, [x if x in terms else "" for x in w]) for d, w in docs]
    assert got >= by_the_rule(short, items) and len(got) <= len(by_the_rule(short, items, 0.6, 0.5)) + 2


def test_words_of_any_blanks_and_case(spark):
    """Verbatim copies in other blanks and in capitals, and how words are cut, against plain Python."""
    import re

    import pyarrow as pa

    from vecroute.llm.decontaminate import word_codes

    ten = "quasar lintel mordant vexil brumal ostler pavane wicket sorrel tundra".split()
    greek = "λόγος σοφίας θάλασσα ουρανός άνθρωπος πόλις νόμος μύθος κόσμος φίλος".split()
    items = [(1, " ".join(ten)), (2, " ".join(greek)), (3, "Straße führt über Brücke nach Köln am Rhein entlang weiter"), (4, "ostler pavane")]
    docs = [
        (10, "start " + " ".join(ten) + " end"), (11, "　".join([*ten, "more", "text"])), (12, "x " + " ".join(greek).upper() + " y"),
        (13, "STRASSE FÜHRT ÜBER BRÜCKE NACH KÖLN AM RHEIN ENTLANG WEITER"), (14, " ".join(["an", "Ostler,", "PAVANE"])), (15, "nothing of these is here at all"),
        (16, " ".join(ten).replace(" ", "\x1d")), (17, "\x85".join(ten)),
    ]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == {(d, 1) for d in (10, 11, 16, 17)} | {(12, 2), (13, 3)} | {(d, 4) for d in (10, 11, 14, 16, 17)}
    rng = random.Random(9)
    letters = "aB é ß 　 \t\n_-.Σσς1٣İ日\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    want = [[w for w in (re.sub(r"[\W_]+", "", x.casefold()) for x in t.split()) if w] for t in texts]
    assert [normal_words(t) for t in texts] == want
    rows, codes, names = word_codes(pa.array(texts))  # all at once
    names, got = names.to_pylist(), [[] for _ in texts]
    for r, c in zip(rows, codes, strict=True):
        if names[c]:
            got[r].append(names[c])
    assert got == want


def test_words_folded_together_are_those_folded_alone():
    """Words of a batch, ASCII or not, with marks, controls and a line's end inside, as by one word at a time."""
    words = ["Plain,", "it's_", "", "--", "É_x", "ΣΑΣ", "straße!", "İ", "²½", "中-文", "a\x00b", "é\nB", "٣", "😀"]
    alone = [re.sub(r"[\W_]+", "", w.casefold()) for w in words]
    for some in (words, [w for w in words if "\n" not in w]):
        whole = pa.array(["-", *some], pa.large_string()).slice(1)
        assert decontaminate.plain_words(whole).to_pylist() == [a for a, w in zip(alone, words, strict=True) if w in some]


def test_all_classes_take_one_pass_over_the_words(spark, monkeypatch):
    """Items of three length classes: their passages are written once, and each class finds its own leak."""
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{k}x{j}" for j in rng.permutation(n))) for k, n in enumerate((8, 16, 40))]
    docs = [(k, f"before it {text} and after") for k, text in items] + [(9, "nothing of them here")]
    passes = []
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name, *a, kept=decontaminate.materialise, **b: (passes.append(name), kept(df, name, *a, **b))[1])
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert passes.count("passages") == 1
