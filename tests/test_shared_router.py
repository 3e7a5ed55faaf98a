"""The shared router against ``pyspark.ml``'s own results, plain arithmetic, and the list baseline."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise
from vecroute.operators import ivf, knn, metrics, search, training
from vecroute.operators.assign import rank_histogram
from vecroute.operators.router import node_probs, router_trees
from vecroute.operators.shared_router import SharedRouter, SharedTree, fit_shared, pair_losses, shared_trees

K, H = 3, 2


def random_tree(seed, width=4, units=5, k=K, h=H):
    rng = np.random.default_rng(seed)
    return SharedTree(k, h, rng.normal(0, 1, (units, width + (h - 1) * k + h)), rng.normal(0, 1, units), rng.normal(0, 1, (k, units)), rng.normal(0, 1, k))


def router_of(tree):
    """As a fitted router that scales nothing."""
    n_in, units = tree.into.shape[1], len(tree.bias)
    flat = np.concatenate([tree.into.T.ravel(), tree.bias, tree.out.T.ravel(), tree.out_bias])
    return SharedRouter(tree.k, tree.h, [n_in, units, tree.k], flat, np.zeros(tree.width), np.ones(tree.width))


def plain_scores(t, x, prefix):
    """Log-probabilities of a node's branches, one number at a time."""
    inputs = [*x, *(float(d < len(prefix) and prefix[d] == b) for d in range(t.h - 1) for b in range(t.k)), *(float(d == len(prefix)) for d in range(t.h))]
    hidden = [1 / (1 + math.exp(-(sum(w * v for w, v in zip(row, inputs, strict=True)) + b))) for row, b in zip(t.into, t.bias, strict=True)]
    logit = [sum(w * v for w, v in zip(row, hidden, strict=True)) + b for row, b in zip(t.out, t.out_bias, strict=True)]
    return [z - math.log(sum(map(math.exp, logit))) for z in logit]


def test_scores_are_the_formula():
    t = random_tree(1)
    x = np.random.default_rng(2).normal(0, 1, (6, 4))
    for prefix in ((), (0,), (2,)):
        got = t.log_probs(t.encode(x), prefix)[1]
        assert got == pytest.approx(np.array([plain_scores(t, v, prefix) for v in x]), abs=1e-5)
        assert np.exp(got).sum(axis=1) == pytest.approx(np.ones(6), abs=1e-4)
    mixed = np.array([[0], [2], [1], [1], [0], [2]])
    assert t.scores(t.encode(x), mixed) == pytest.approx(np.array([plain_scores(t, v, tuple(p)) for v, p in zip(x, mixed, strict=True)]), abs=1e-5)
    losses = t.path_losses(x, np.array([[0, 1]] * 6))
    assert losses == pytest.approx([-plain_scores(t, v, ())[0] - plain_scores(t, v, (0,))[1] for v in x])
    for bad in (np.array([[3]]), np.array([[-1]]), np.array([[0, 1]])):
        with pytest.raises(ValueError):
            t.scores(t.encode(x), bad)
    with pytest.raises(ValueError, match="width"):
        t.encode(np.zeros((1, 5)))


def test_table_and_back(spark):
    trees = {i: random_tree(i) for i in (0, 1, 4)}
    table = None
    for i, t in trees.items():
        one = router_of(t).table(spark, i)
        table = one if table is None else table.unionByName(one)
    back = shared_trees(table)
    assert list(back) == [0, 1, 4] and all(np.array_equal(back[i].into, t.into) and np.array_equal(back[i].out, t.out) for i, t in trees.items())
    groups = router_trees(table, 2 * trees[0].nbytes)
    assert [list(g) for g in groups] == [[0, 1], [4]]


def test_beam_and_nodes_in_groups_of_trees(spark):
    """Search and node probabilities with a shared router, all trees at once and one after the other."""
    trees = {i: random_tree(10 + i) for i in range(3)}
    table = None
    for i, t in trees.items():
        table = router_of(t).table(spark, i) if table is None else table.unionByName(router_of(t).table(spark, i))
    x = np.random.default_rng(3).normal(0, 1, (5, 4))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<double>")
    want = []
    for tree, t in trees.items():
        for i, v in enumerate(x):
            first = plain_scores(t, v, ())
            leaves = sorted(((-(first[a] + p), (a, b)) for a in range(K) for b, p in enumerate(plain_scores(t, v, (a,)))))
            want += [(i, tree, rank, p) for rank, (_, p) in enumerate(leaves[:4])]
    for most in (1 << 20, 1):
        got = search.beam_search(q, table, K, H, 9, 4, router_bytes=most).collect()
        assert sorted((r["query_id"], r["tree_id"], r["leaf_rank"], tuple(r["path"])) for r in got) == sorted(want)
        nodes = q.select(F.col("query_id").alias("vec_id"), "embedding", F.explode(F.array(F.lit(0), F.lit(2))).alias("tree_id"))
        nodes = nodes.withColumn("prefix", F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)")))
        for r in node_probs(nodes, table, router_bytes=most).collect():
            assert r["probs"] == pytest.approx(np.exp(plain_scores(trees[r["tree_id"]], x[r["vec_id"]], tuple(r["prefix"]))), abs=1e-5)


def pairs_of(spark, rows):
    return materialise(spark.createDataFrame([(v.tolist(), p) for v, p in rows], "embedding array<double>, path array<int>"), "pairs")


def test_weights_are_those_of_the_library(spark, monkeypatch):
    """Probabilities of the fitted model by ``pyspark.ml`` itself, on the inputs that it was given."""
    rng = np.random.default_rng(5)
    rows = [(rng.normal(3, 2, 4), [int(rng.integers(0, K)), int(rng.integers(0, K))]) for _ in range(60)]
    seen = {}
    fit = training.fit_shared.__globals__["MultilayerPerceptronClassifier"].fit

    def keep(self, data, *args):
        seen["model"], seen["data"] = fit(self, data, *args), data
        return seen["model"]

    monkeypatch.setattr(training.fit_shared.__globals__["MultilayerPerceptronClassifier"], "fit", keep)
    router = fit_shared(pairs_of(spark, rows), K, H, 4, 15)
    assert isinstance(seen["model"], MultilayerPerceptronClassificationModel)
    p = np.array([r["p"] for r in seen["model"].transform(seen["data"]).select(vector_to_array("probability").alias("p")).collect()])
    t = router.tree
    x, paths = np.array([v for v, _ in rows]), np.array([p for _, p in rows])
    ours = np.exp(np.stack([t.scores(t.encode(x), paths[:, :d], 12) for d in range(H)], axis=1)).reshape(-1, K)
    assert ours[np.lexsort(ours.T)] == pytest.approx(p[np.lexsort(p.T)], abs=1e-8)
    assert pair_losses(router, pairs_of(spark, rows)).agg(F.avg("loss")).first()[0] == pytest.approx(t.path_losses(x, paths).mean())


def test_path_and_vector_act_together(spark):
    """Which side of a line is branch 0 depends on the node: no sum of a vector's part and a path's part says so."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(400):
        v, first = rng.normal(0, 1, 2), int(rng.integers(0, 2))
        rows.append((v, [first, int((v[0] > 0) ^ (first == 1))]))
    pairs = pairs_of(spark, rows)
    router = fit_shared(pairs, 2, 2, 12, 150, seed=3)
    t, x, paths = router.tree, np.array([v for v, _ in rows]), np.array([p for _, p in rows])
    second = t.scores(t.encode(x), paths[:, :1]).argmax(axis=1)
    assert (second == paths[:, 1]).mean() > 0.95
    before = pair_losses(router, pairs).agg(F.avg("loss")).first()[0]
    again = fit_shared(pairs, 2, 2, 12, 10, seed=9, start=router)  # goes on from there
    assert pair_losses(again, pairs).agg(F.avg("loss")).first()[0] <= before + 1e-6


def test_learned_partition_beats_lists(spark):
    """Directions matter, lengths don't: lists by centroids part vectors by their lengths, too, the router learns not to.

    With less than half of the candidates that the lists take, its recall is higher."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (16, 12))
    x = centres[np.arange(1280) % 16] + rng.normal(0, 0.35, (1280, 12))
    x *= rng.lognormal(0, 0.9, (1280, 1))
    v = materialise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), "vectors")
    q = materialise(v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "asked")
    truth = materialise(knn.exact_knn(q, v, 10, "angular"), "truth")
    s = training.TrainSettings(4, 2, top_k=10, metric="angular", query_fraction=0.4, max_cycles=4, max_iter=40, hidden=32)
    router, paths, _ = training.alternating_train(v, s)
    beam = search.beam_search(q, router.table(spark), 4, 2, 16, 2)
    found = search.select_candidates(search.leaf_lookup(beam, paths), 1)
    ours = metrics.recall_per_query(search.rerank(found, q, v, 10, "angular"), truth, 10).agg(F.avg("recall")).first()[0]
    lists, centroids = ivf.build_ivf(v, 16)
    results, probed = ivf.search_ivf(q, v, lists, centroids, 2, 10, "angular")
    theirs = metrics.recall_per_query(results, truth, 10).agg(F.avg("recall")).first()[0]
    assert 2 * found.count() <= probed.count() and ours > theirs


@pytest.mark.parametrize("subset,times", [(None, 1), (200, 1), (50, 2)])
def test_neighbours_among_all_vectors_are_mined_once(spark, monkeypatch, subset, times):
    mined, mine = [], training.mine_labels
    monkeypatch.setattr(training, "mine_labels", lambda *a: mined.append(a) or mine(*a))
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    s = training.TrainSettings(3, 1, query_fraction=0.3, top_k=3, subset_size=subset, max_cycles=2, max_iter=2, hidden=4)
    training.alternating_train(v, s)
    assert len(mined) == times


def test_small_tables_need_no_python_workers(spark):
    tree = random_tree(3)
    made = router_of(tree).table(spark, 7)
    assigned = spark.range(3).select(F.lit(0).alias("chosen_rank"), F.lit(False).alias("used_fallback"))
    for df in (made, rank_histogram(assigned)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    (found,) = shared_trees(made).values()
    assert np.array_equal(found.into, tree.into) and np.array_equal(found.out, tree.out) and np.array_equal(found.out_bias, tree.out_bias)
