import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vecroute.llm import merkle
from vecroute.llm.merkle import fold, manifest, proof, row_digest
from vecroute.llm.q_merkle import COLUMNS, op13_merkle_manifest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan):
    """All levels of a tree, the last of one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    return levels


def beside(levels, place, fan):
    """(siblings to the left, to the right) at each level."""
    out = []
    for level in levels[:-1]:
        low = place // fan * fan
        out.append((level[low:place], level[place + 1 : low + fan]))
        place //= fan
    return out


def by_hand(rows, fan):
    """(leaf, subroot, root, path) of each row of (doc_id, source, leaf), by lists."""
    groups = {}
    for doc, source, leaf in rows:
        groups.setdefault(source, []).append(((doc is not None, doc or 0), leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, leaf in sorted(groups[s])], fan) for s in order}
    top = tree([trees[s][-1][0] for s in order], fan)
    out = []
    for s in order:
        for i, leaf in enumerate(trees[s][0]):
            path = beside(trees[s], i, fan) + beside(top, order.index(s), fan)
            out.append((leaf, trees[s][-1][0], top[-1][0], tuple(("".join(a), "".join(b)) for a, b in path)))
    return out


def made(spark, rows, fan):
    found = manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), "source", ["doc_id"], fan)
    return found.withColumn("folded", fold(F.col("leaf"), F.col("path"))).withColumn("proof", proof(F.col("path"))).collect()


@pytest.mark.parametrize("fan,sizes", [(2, [1, 2, 3, 9]), (3, [1, 28, 4]), (16, [300, 1, 17, 16, 257, 15])])
def test_against_lists(spark, fan, sizes, monkeypatch):
    rows = [(i, None if not g else f"s{g}é", sha(f"{g} {i}")) for g, n in enumerate(sizes) for i in range(n)]
    for hot in (4096, 2) if fan == 3 else (4096,):  # nearly all nodes, and few, are broadcast
        monkeypatch.setattr(merkle, "HOT", hot)
        found = made(spark, rows[::-1], fan)
        assert sorted((r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in found) == sorted(by_hand(rows, fan))
        assert all(r.folded == r.root and r.proof == "".join(a + b for a, b in r.path) for r in found)


def test_many_groups(spark):
    rows = [(i, f"g{i % 90}", sha(str(i))) for i in range(200)]
    assert sorted((r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in made(spark, rows, 4)) == sorted(by_hand(rows, 4))


def test_defined_cases(spark):
    assert made(spark, [], 16) == []
    (one,) = made(spark, [(5, "a", sha("x"))], 16)
    assert one.subroot == one.root == one.leaf == one.folded and one.path == [] and one.proof == ""
    ties = [(None, None, sha("b")), (None, None, sha("a")), (1, None, sha("c")), (1, None, sha("c")), (1, "", sha("c"))]
    assert sorted((r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in made(spark, ties, 2)) == sorted(by_hand(ties, 2))
    kept = manifest(spark.createDataFrame([(1, "a", "x", "more")], "doc_id long, source string, leaf string, digest string"), "source", ["doc_id"])
    assert kept.first().digest == "more"
    with pytest.raises(ValueError):
        manifest(spark.createDataFrame([(1, "a", "x", 2)], "doc_id long, source string, leaf string, place int"), "source", ["doc_id"])


def test_row_digests(spark):
    rows = [(1, "s", "de", 3, "aé日"), (None,) * 5, (2, "", None, 0, ""), (-3, "-", "1:x", 5, "t" * 300_000)]
    found = spark.createDataFrame(rows, SCHEMA).select("doc_id", row_digest([F.col(c) for c in COLUMNS]).alias("h")).collect()
    assert [r.h for r in found] == [leaf_of(r) for r in rows]


def test_query_against_lists(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = {r[0]: leaf_of((*r[:4], r[4].translate(upper))) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None}
    want = {}
    ids = {leaf_of(r): r[0] for r in rows}
    for leaf, subroot, root, path in by_hand([(r[0], r[1], leaf_of(r)) for r in rows], 16):
        now = other.get(ids[leaf], leaf)
        for a, b in path:
            now = sha(a + now + b)
        want[ids[leaf]] = (leaf, subroot, root, sha("".join(a + b for a, b in path)), now, now == root)
    found = {r.doc_id: tuple(r)[1:] for r in op13_merkle_manifest(spark, SF).collect()}
    assert found == want and {v[-1] for v in want.values()} == {True, False}


def test_a_run_asks_once_a_level(spark, monkeypatch):
    """What is asked has a row for each run and level, and is made once, also where nodes are near and far."""
    written, write = {}, merkle.materialise
    monkeypatch.setattr(merkle, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(merkle, "HOT", 2)
    sizes = {"a": 300, "b": 17, "c": 1}
    rows = [(i, g, sha(f"{g} {i}")) for g, n in sizes.items() for i in range(n)]
    found = manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), "source", ["doc_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # leaves of their runs
    asked = written["merkle-asked"]
    assert asked.count() == 19 * (2 + 1) + 2 * (1 + 1) + 1  # runs of a group, levels above them
    assert {r.hot for r in asked.select("hot").distinct().collect()} == {True, False}
