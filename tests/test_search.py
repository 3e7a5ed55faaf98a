"""Search over made trees against a plain search, and what search is made of against plain versions."""

import hashlib
import itertools
import math
import random
import statistics
import struct
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecroute.functions.paths import checked_path, leaf_to_path, path_to_leaf, random_init
from vecroute.operators import knn, metrics, search, training
from vecroute.operators.router import node_probs

K, H = 3, 2


def made(seed, n=40, n_trees=2, width=3):
    """(vectors, a path of each vector per tree, a linear router's weights by tree and prefix)."""
    rng = random.Random(seed)
    vectors = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    paths = [[(rng.randrange(K), rng.randrange(K)) for _ in range(n)] for _ in range(n_trees)]
    paths = [[p if p[0] != 2 else (0, 1) for p in tree] for tree in paths]  # three leaves of each tree stay empty
    prefixes = [(), *((b,) for b in range(K))]
    router = {(t, p): [([rng.gauss(0, 1) for _ in range(width)], rng.gauss(0, 0.5)) for _ in range(K)] for t in range(n_trees) for p in prefixes}
    return vectors, paths, router


def frames(spark, vectors, paths, router, asked):
    rows = [(t, list(p), b, w, bias) for (t, p), branches in router.items() for b, (w, bias) in enumerate(branches)]
    trees = [(t, i, list(p), p[0] * K + p[1]) for t, tree in enumerate(paths) for i, p in enumerate(tree)]
    return (
        spark.createDataFrame(rows, "tree_id int, prefix array<int>, branch int, weight array<double>, bias double"),
        spark.createDataFrame(trees, "tree_id int, vec_id long, path array<int>, leaf_id long"),
        spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"),
        spark.createDataFrame(list(enumerate(asked)), "query_id long, embedding array<double>"),
    )


def plain_beam(router, t, q, beam):
    """All partial paths by falling score, level by level."""
    now = [((), 0.0)]
    for _ in range(H):
        grown = []
        for prefix, score in now:
            logit = [sum(x * y for x, y in zip(q, w, strict=True)) + bias for w, bias in router[t, prefix]]
            total = math.log(sum(math.exp(x) for x in logit))
            grown += [((*prefix, b), score + x - total) for b, x in enumerate(logit)]
        now = sorted(grown, key=lambda x: (-x[1], x[0]))[:beam]
    return now


def plain_search(vectors, paths, router, q, beam, k, leaves, least):
    counts = Counter()
    for t, tree in enumerate(paths):
        open_leaves = {p for p, _ in plain_beam(router, t, q, beam)[:leaves]}
        counts.update(i for i, p in enumerate(tree) if p in open_leaves)
    chosen = [i for i, n in counts.items() if n >= least] or list(counts)
    near = sorted(chosen, key=lambda i: (math.dist(q, vectors[i]), i))
    return [*near, *[-1] * k][:k], len(chosen)


@pytest.mark.parametrize("seed, n_trees, beam, leaves, least", [(1, 1, 1, None, None), (2, 2, 2, None, None), (3, 2, 1, 1, 1), (4, 3, 4, 2, 3), (5, 2, 9, 3, 2), (6, 3, 9, 9, 2)])
def test_search_equals_plain_search(spark, seed, n_trees, beam, leaves, least):
    vectors, paths, router = made(seed, n_trees=n_trees)
    asked = made(seed + 100, n=6)[0]
    r, t, v, q = frames(spark, vectors, paths, router, asked)
    found, candidates = search.search(q, r, t, v, K, H, n_trees, beam, 8, leaves, least)
    wide = {x["query_id"]: x["ids"] for x in search.to_wide(found, q, 8).collect()}
    counts = {x["query_id"]: x["n_candidates"] for x in metrics.candidate_counts(candidates, q).collect()}
    for i, x in enumerate(asked):
        assert (wide[i], counts[i]) == plain_search(vectors, paths, router, x, beam, 8, leaves or beam, least or min(2, n_trees))


def test_beam_order(spark):
    vectors, paths, router = made(9, n_trees=1)
    asked = made(10, n=4)[0]
    r, _, _, q = frames(spark, vectors, paths, router, asked)
    for settings, (i, x) in itertools.product(({}, {"router_bytes": 0}), enumerate(asked)):
        rows = search.beam_search(q.where(F.col("query_id") == i), r, K, H, 9, **settings).orderBy("leaf_rank").collect()
        want = plain_beam(router, 0, x, 9)
        got = [y for y in rows if y["query_id"] == i]
        assert [tuple(y["path"]) for y in got] == [p for p, _ in want]
        assert [y["leaf_id"] for y in got] == [a * K + b for (a, b), _ in want] and [y["leaf_rank"] for y in got] == list(range(9))
        assert [y["score"] for y in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_probabilities_of_nodes(spark):
    """Both physical forms, on a router that lacks a branch."""
    vectors, paths, router = made(13, n_trees=2)
    r, t, v, _ = frames(spark, vectors, paths, router, [[0.0]])
    r = r.where("not (tree_id = 1 and branch = 1)")
    nodes = t.join(v, "vec_id").select("tree_id", F.slice("path", 1, 1).alias("prefix"), "vec_id", "embedding")
    key = lambda x: (x["tree_id"], x["vec_id"], list(x["prefix"]), [round(p, 5) for p in x["probs"]])
    got, joined = (sorted(map(key, node_probs(nodes, r, **s).collect())) for s in ({}, {"router_bytes": 0}))
    assert got == joined and {len(x[3]) for x in got if x[0] == 1} == {2} and len(got) == 80


def test_empty_leaves_pad_results(spark):
    vectors, paths, router = made(11, n_trees=1)
    router = {key: [(w, 50.0 if b == 2 and not key[1] else bias) for b, (w, bias) in enumerate(x)] for key, x in router.items()}
    r, t, v, q = frames(spark, vectors, paths, router, [[0.0, 0.0, 0.0]])
    found, _ = search.search(q, r, t, v, K, H, 1, 1, 4)
    assert [x["ids"] for x in search.to_wide(found, q, 4).collect()] == [[-1] * 4]


def test_widths_are_checked(spark):
    vectors, paths, router = made(12, n_trees=1)
    r, t, v, q = frames(spark, vectors, paths, router, [[0.1, 0.2]])
    with pytest.raises(Exception, match="width"):
        search.beam_search(q, r, K, H, 2).collect()
    with pytest.raises(Exception, match="width"):
        search.beam_search(q, r, K, H, 2, router_bytes=0).collect()
    with pytest.raises(Exception, match="width"):
        knn.exact_knn(q, v, 2).collect()
    odd = v.union(spark.createDataFrame([(99, [1.0])], v.schema)).coalesce(1)
    pairs = spark.createDataFrame([(0, i) for i in (0, 99)], "query_id long, vec_id long")
    for broken in (lambda: knn.exact_knn(q, odd, 2), lambda: search.rerank(pairs, q, odd, 2), lambda: search.rerank(pairs, q, v.limit(1), 2)):
        with pytest.raises(Exception, match="width"):
            broken().collect()


def test_bad_settings():
    for beam, leaves in ((2, 4), (2, 0)):
        with pytest.raises(ValueError):
            search.check_beam(beam, leaves)
    with pytest.raises(ValueError):
        search.check_min_trees(2, 1)
    assert search.check_min_trees(None, 1) == 1 and search.check_min_trees(None, 4) == 2


@pytest.mark.parametrize("metric", ["euclidean", "angular", "cosine", "inner_product"])
def test_exact_neighbours(spark, metric):
    """Broadcast and salted query blocks, against all distances."""
    vectors, asked = made(20, n=70)[0], made(21, n=9)[0]
    vectors[5] = vectors[4]  # a tie
    _, _, v, q = frames(spark, vectors, [], {(0, ()): [([0.0], 0.0)]}, asked)
    length = lambda x: math.sqrt(sum(y * y for y in x))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    single = lambda x: [struct.unpack("f", struct.pack("f", y))[0] for y in x]
    of = {"euclidean": math.dist, "inner_product": lambda a, b: -dot(a, b)}.get(metric, lambda a, b: 1 - dot(a, b) / (length(a) * length(b)))
    want = []
    for i, x in enumerate(asked):
        near = sorted((round(of(single(x), single(y)), 9), j) for j, y in enumerate(vectors))[:4]
        want += [(i, rank, j) for rank, (_, j) in enumerate(near)]
    for settings in ({}, {"query_block": 2}, {"query_block": 3, "broadcast_bytes": 0}, {"query_block": 2, "broadcast_bytes": 40}):
        got = knn.exact_knn(q, v.repartition(5), 4, metric, **settings).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == want
    with pytest.raises(ValueError):
        knn.exact_knn(q, v, 2, "jaccard")


def test_sample_is_that_of_the_hash(spark):
    _, _, v, _ = frames(spark, made(22)[0], [], {(0, ()): [([0.0], 0.0)]}, [[0.0]])
    by_hash = sorted(range(40), key=lambda i: hashlib.md5(f"3-{i}".encode()).hexdigest())
    assert sorted(r["vec_id"] for r in knn.sample_ids(v, 7, 3).collect()) == sorted(by_hash[:7])
    assert knn.sample_ids(v, 100, 3).count() == 40


def test_paths_and_first_trees(spark):
    ids = spark.range(81).select(F.col("id").alias("leaf"), leaf_to_path(F.col("id"), 3, 4).alias("p"))
    got = ids.select("leaf", "p", path_to_leaf(F.col("p"), 3).alias("back"), checked_path(F.col("p"), 3, 4).alias("same")).collect()
    assert all(r["leaf"] == r["back"] and r["p"] == r["same"] for r in got) and got[5]["p"] == [0, 0, 1, 2]
    for k, h in ((2, 4), (3, 3)):
        with pytest.raises(Exception, match="no path"):
            ids.select(checked_path(F.col("p"), k, h)).collect()
    trees = random_init(spark.range(50).withColumnRenamed("id", "vec_id"), 3, 3)
    stats = metrics.leaf_size_stats(trees, 3, 3).first()
    assert (stats["min"], stats["max"], stats["num_empty"]) == (1, 2, 0)


def test_unknown_neighbours_are_an_error(spark):
    _, t, v, q = frames(spark, *made(23, n_trees=1), [[0.0, 0.0, 0.0]])
    near = lambda i: spark.createDataFrame([(0, 0, i)], "query_id long, rank int, vec_id long")
    assert training.training_pairs(q, near(3), t, K).count() == 1
    with pytest.raises(Exception, match="isn't in the tree"):
        training.training_pairs(q, near(400), t, K).collect()
    with pytest.raises(Exception, match="no path"):
        training.training_pairs(q, near(3), t, 1).collect()


def test_leaf_stats_and_gini(spark):
    rng = random.Random(30)
    leaves = [rng.choice([0, 0, 0, 3, 5]) for _ in range(30)]
    trees = spark.createDataFrame([(0, i, [x // 3, x % 3], x) for i, x in enumerate(leaves)], "tree_id int, vec_id long, path array<int>, leaf_id long")
    sizes = sorted(leaves.count(x) for x in range(9))
    s = metrics.leaf_size_stats(trees, 3, 2).first()
    assert (s["min"], s["max"], s["num_empty"]) == (sizes[0], sizes[-1], sizes.count(0))
    assert s["mean"] == pytest.approx(30 / 9) and s["std"] == pytest.approx(statistics.pstdev(sizes))
    assert s["gini"] == pytest.approx(sum(abs(a - b) for a in sizes for b in sizes) / (2 * 9 * 30))


def test_recall(spark):
    rng = random.Random(31)
    results = [[rng.randrange(-1, 12) for _ in range(6)] for _ in range(20)]
    truth = [rng.sample(range(12), 6) for _ in range(20)]
    long = lambda lists: spark.createDataFrame([(q, r, v) for q, ids in enumerate(lists) for r, v in enumerate(ids)], "query_id long, rank int, vec_id long")
    for k in (1, 4, 6):
        got = [r["recall"] for r in metrics.recall_per_query(long(results), long(truth), k).orderBy("query_id").collect()]
        assert got == pytest.approx([len({*a[:k]} & {*b[:k]}) / k for a, b in zip(results, truth, strict=True)])
    with pytest.raises(ValueError):
        metrics.recall_per_query(long(results), long(truth), 7)


def test_vectors_meet_all_blocks_of_queries_as_one_row(spark, monkeypatch):
    """A task gets each vector once and each block of queries once, whatever the number of blocks."""

    def count(*_):
        def run(batches):
            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_pydict({"query_id": [0], "vec_id": [n], "distance": [0.0], "strict": [True]})

        return run

    _, _, v, q = frames(spark, made(23, n=70)[0], [], {(0, ()): [([0.0], 0.0)]}, made(24, n=60)[0])
    monkeypatch.setattr(knn, "_nearest", count)
    rows = sum(r["vec_id"] for r in knn.exact_knn(q, v.repartition(2), 9, query_block=2).collect())
    assert rows == 70 + 2 * 30


def test_bound_of_blocks_before_loses_no_neighbour():
    rng = np.random.default_rng(1)
    q, v = rng.integers(0, 3, (7, 4)).astype(float), rng.integers(0, 3, (200, 4)).astype(float)  # many ties
    for metric in ("euclidean", "angular", "inner_product"):
        one = list(zip(*knn.block_top_k(q, v, np.arange(200), 5, metric), strict=True))
        bound, parts = np.full(7, np.inf), []
        for a in range(0, 200, 20):
            parts += zip(*knn.block_top_k(q, v[a : a + 20], np.arange(a, a + 20), 5, metric, bound), strict=True)
        near = sorted(parts, key=lambda x: (x[0], round(x[2], 9), x[1]))
        assert [x[:2] for x in one] == [x[:2] for i in range(7) for x in [y for y in near if y[0] == i][:5]]


@pytest.mark.parametrize("seed, n_trees, leaves, least", [(31, 1, 1, 1), (32, 2, 2, 1), (33, 2, 1, 2), (34, 3, 3, 2), (35, 3, 2, 3)])
def test_cells_tell_the_candidates_of_leaves(spark, monkeypatch, seed, n_trees, leaves, least):
    """Candidates, their numbers and their nearest, by cells, in one lot and in many, as by pairs."""
    vectors, paths, router = made(seed, n_trees=n_trees)
    r, t, v, q = frames(spark, vectors, paths, router, made(seed + 100, n=6)[0])
    beam = search.materialise(search.beam_search(q, r, K, H, leaves), "beam")
    counts = Counter((x["query_id"], x["vec_id"]) for x in beam.join(t, ["tree_id", "leaf_id"]).collect())
    best = {i: max([n for (j, _), n in counts.items() if j == i], default=0) for i in range(6)}
    want = sorted((i, j, n) for (i, j), n in counts.items() if n >= least or best[i] < least)
    cells = search.vector_cells(t)
    for lot in (4096, 2):
        monkeypatch.setattr(search, "LOT", lot)
        assert sorted(tuple(x) for x in search.probed_candidates(beam, cells, n_trees, least).collect()) == want
        assert sorted((x["query_id"], x["vec_id"]) for x in search.leaf_lookup(beam, t).collect()) == sorted(counts.elements())
    numbers = {x["query_id"]: x["n_candidates"] for x in search.probed_counts(beam, cells, q, n_trees, least).collect()}
    assert numbers == {i: sum(1 for x in want if x[0] == i) for i in range(6)}
    pairs = spark.createDataFrame(want, "query_id long, vec_id long, n_trees int")
    for metric in ("euclidean", "angular"):
        near = search.rerank_probed(beam, search.by_cell(v, cells), q, n_trees, least, 5, metric)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, search.rerank(pairs, q, v, 5, metric).collect()))


@pytest.mark.parametrize("of", ["leaf_lookup", "probed_candidates"])
def test_tasks_follow_the_pairs(spark, monkeypatch, of):
    """A leaf that holds all vectors and is asked for by all queries is dealt over tasks; none makes most of the pairs."""
    monkeypatch.setattr(search, "LOT", 8)
    monkeypatch.setattr(search, "TASK_PAIRS", 2000)
    t = spark.createDataFrame([(0, i, [0], 0) for i in range(300)], "tree_id int, vec_id long, path array<int>, leaf_id long")
    beam = spark.createDataFrame([(i, 0, 0, [0], 0, 0.0) for i in range(100)], "query_id long, tree_id int, leaf_rank int, path array<int>, leaf_id long, score double")
    found = search.leaf_lookup(beam, t) if of == "leaf_lookup" else search.probed_candidates(beam, search.vector_cells(t), 1, 1)
    made = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(made) == 30_000 and found.distinct().count() == 30_000
    assert len(made) > 8 and max(made) < 7500


def test_memory_of_a_mining_task():
    """What a task holds beside its queries and their best is small, whatever the vectors."""
    n, width, rows, k = 8000, 64, 10_000, 5
    rng = np.random.default_rng(0)

    def lists(m):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))

    asked = pa.StructArray.from_arrays([pa.array(np.arange(n)), lists(rng.random((n, width), np.float32))], names=["query_id", "embedding"])

    def batches():
        first = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), asked)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), first, pa.array([0]), lists(np.zeros((1, width), np.float32))], names=list("abcd"))
        for i in range(4):
            made = [pa.array(np.full(rows, -1, np.int32)), pa.nulls(rows, first.type), pa.array(np.arange(rows) + i * rows), lists(rng.random((rows, width), np.float32))]
            yield pa.RecordBatch.from_arrays(made, names=list("abcd"))

    tracemalloc.start()
    found = sum(b.num_rows for b in knn._nearest(1, k, "euclidean", None)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * k and peak < 40 << 20
