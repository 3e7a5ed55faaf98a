import random

import numpy as np
import pyarrow as pa

from vecroute.llm import prob_minhash
from vecroute.llm.prob_minhash import likely, near_duplicates, shingles, signature, signatures
from vecroute.llm.q_dedup import op3_prob_minhash

SF = "/root/testdata/sf0.001"


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """Least id of each row's component; equal texts are linked, and texts without words never are."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, least.get(root(i)) if s[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(copy) // 12])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(200)]  # each is near the next only
    for _ in range(12):
        rows.append(" ".join(chain))
        at = rng.randrange(180)
        chain[at : at + 4] = [word() for _ in range(4)]
    rows += ["", None, "  ", "one", "one", "a b c d", "a b c d e", "x " * 30_000, "x " * 200, None]
    return list(enumerate(rows)) + [(None, rows[0]), (None, "single text without an id at all"), (3, rows[3])] + [
        (None, " ".join(f"n{i}" for i in range(60)) + end) for end in ("", " more", " other")
    ]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, node string").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_copies_that_differ_among_themselves(spark):
    """Copies near one base but not each other, and a crowd that shares a template yet stays apart."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(2 if i % 2 else 5):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows)


def test_estimate_of_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(1, 2**63, 80).astype(np.uint64)])
    w = 1 + np.log(rng.integers(1, 6, 400))
    wb = np.concatenate([w[:320], 1 + np.log(rng.integers(1, 6, 80))])
    of_a, of_b = dict(zip(a.tolist(), w)), dict(zip(b.tolist(), wb))
    keys = set(of_a) | set(of_b)
    exact = sum(
        1 / sum(max(of_a.get(y, 0) / of_a[x], of_b.get(y, 0) / of_b[x]) for y in keys) for x in set(of_a) & set(of_b)
    )
    same = (signature(a, w, 2000) == signature(b, wb, 2000)).mean()
    assert abs(same - exact) < 0.04


def test_shingles_of_short_texts():
    values, ends = shingles(pa.array(["a b c", "a b c", "a b", "", None, "a b c d e", "a b c d e f"]))
    assert np.diff(ends).tolist() == [1, 1, 1, 0, 0, 1, 2]
    assert values[0] == values[1] != values[2] and values[3] == values[4]


def test_recall_by_similarity(spark):
    """Of all pairs of sf0.01 at 0.8 or more, all are in one class; no class holds a text without a link."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op3_prob_minhash(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_blocks_by_number_and_by_size(spark, monkeypatch):
    """A crowd that shares a template, in blocks of a few nodes and of a few bytes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(100), 3 if i % 3 else 2):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = prob_minhash._open_links
    for settings in ({"block": 8}, {"block_bytes": 4000}):
        monkeypatch.setattr(prob_minhash, "_open_links", lambda *a, s=settings: whole(*a, **s))
        assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows)


def test_estimate_decides_what_is_verified(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    near = a.replace("a7 ", "z ")
    nodes = signatures(spark.createDataFrame([(0, a), (1, b), (2, near)], "id long, text string"), "id", "text").orderBy("id").collect()
    key = [bytes(r["node"]) for r in nodes]
    pairs = spark.createDataFrame([(key[0], key[1]), (key[0], key[2])], "a binary, b binary")
    table = spark.createDataFrame([(key[i], r["registers"]) for i, r in enumerate(nodes)], "node binary, registers binary")
    assert [bytes(r["b"]) for r in likely(pairs, table, 0.55).collect()] == [key[2]]


def test_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op3_prob_minhash(spark, SF).collect()), key=str) == brute(rows)


def test_repeated_lines_do_not_hide_copies(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(24):
        article, line = [word() for _ in range(100)], [word() for _ in range(18)]
        rows += [(2 * i, " ".join(article)), (2 * i + 1, " ".join(article + line * (10, 30, 100)[i % 3]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["id"], r["class_id"]) for r in got.collect()), key=str) == brute(rows)


def test_workers_give_memory_back_after_signing(monkeypatch):
    given = []
    monkeypatch.setattr(prob_minhash, "release_memory", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"id": [1], "node": [b"n"], "text": ["one two three four five six"]})
    assert sum(b.num_rows for b in prob_minhash._sign(iter([batch]))) == 1
    assert len(given) == 2  # what stages before left, and what this one took
