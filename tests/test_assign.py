"""Assignment against a plain, one-list-at-a-time version, with many ties."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vecroute.functions.ranks import places
from vecroute.operators import assign


def plain_rounds(probs, k, cap, order):
    """Every vector not placed tries its t-th branch; lists are kept in the order in which retries arrive."""
    score = {"confidence": max, "margin": lambda p: sorted(p)[-1] - sorted(p)[-2], "input": lambda p: 0.0}[order]
    wanted = [sorted(range(k), key=lambda b: (-p[b], b)) for p in probs]
    queue, counts, out = list(range(len(probs))), [0] * k, {}
    for t in range(k):
        later = []
        for b in range(k):
            here = sorted((i for i in queue if wanted[i][t] == b), key=lambda i: -score(probs[i]))
            free = cap - counts[b]
            for i in here[:free]:
                out[i] = (b, t, False)
            counts[b] += min(len(here), max(free, 0))
            later += here[max(free, 0) :]
        queue = later
    least = counts.index(min(counts))
    out |= {i: (least, k, True) for i in queue}
    return [out[i] for i in range(len(probs))]


def frame(spark, probs, tree=0):
    rows = [(tree, [], i, [float(x) for x in p]) for i, p in enumerate(probs)]
    return spark.createDataFrame(rows, "tree_id int, prefix array<int>, vec_id long, probs array<double>")


def placed(df):
    return [(r["branch"], r["chosen_rank"], r["used_fallback"]) for r in df.orderBy("vec_id").collect()]


@pytest.mark.parametrize("k, cap, order, seed", [(2, 6, "confidence", 1), (3, 4, "input", 2), (4, 3, "margin", 3), (4, 2, "confidence", 4), (5, 3, "input", 5)])
def test_rounds_equal_plain_version(spark, k, cap, order, seed):
    rng = random.Random(seed)
    probs = [[rng.choice([0.1, 0.2, 0.3]) for _ in range(k)] for _ in range(11)]
    for few in (32_768, 0, 3):  # one task a node, no such task, and such tasks for the last rounds
        assert placed(assign.assign_round(frame(spark, probs), k, cap, order, finish_rows=few)) == plain_rounds(probs, k, cap, order)


def test_nodes_of_one_level_in_different_rounds(spark):
    rng = random.Random(40)
    size = {(): 30, (1,): 4, (2,): 13}
    probs = {p: [[rng.choice([0.1, 0.2, 0.3]) for _ in range(4)] for _ in range(n)] for p, n in size.items()}
    rows = [(0, list(p), i, x) for p, part in probs.items() for i, x in enumerate(part)]
    done = assign.assign_round(spark.createDataFrame(rows, "tree_id int, prefix array<int>, vec_id long, probs array<double>"), 4, 4, finish_rows=5).collect()
    for p, part in probs.items():
        got = [(r["branch"], r["chosen_rank"], r["used_fallback"]) for r in sorted((r for r in done if tuple(r["prefix"]) == p), key=lambda r: r["vec_id"])]
        assert got == plain_rounds(part, 4, 4, "confidence")
    assert assign.assign_round(spark.createDataFrame([], "tree_id int, prefix array<int>, vec_id long, probs array<double>"), 4, 4).count() == 0


def test_many_branches_and_rows(spark):
    """256 branches, of which eight are asked for most: every vector placed, none over capacity."""
    n, k = 100_000, 256
    draw = lambda b: F.pmod(F.xxhash64("id", b), F.lit(1 << 20)) / float(1 << 20) * F.when(b < 8, F.lit(1.5)).otherwise(F.lit(1.0))
    rows = spark.range(n).select(F.lit(0).alias("tree_id"), F.expr("cast(array() as array<int>)").alias("prefix"), F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw).alias("probs"))
    began = time.perf_counter()
    got = assign.assign_round(rows, k, -(-n // k)).groupBy("branch").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert tuple(got) == (391, n, k) and time.perf_counter() - began < 120


def test_round_and_sequential_differ(spark):
    probs = [(0.9, 0.1), (0.8, 0.2), (0.2, 0.8)]
    assert [b for b, *_ in placed(assign.assign_round(frame(spark, probs), 2, 1, "input"))] == [0, 0, 1]
    assert placed(assign.assign_sequential(frame(spark, probs), 2, 1, "input")) == [(0, 0, False), (1, 1, False), (0, 2, True)]


def test_sequential_confidence(spark):
    probs = [(0.6, 0.4), (0.9, 0.1), (0.4, 0.6), (0.1, 0.9)]
    assert [b for b, *_ in placed(assign.assign_sequential(frame(spark, probs), 2, 2, "confidence"))] == [0, 0, 1, 1]


def test_diagnostics_and_histogram(spark):
    probs = [(p, 1 - p) for p in (0.51, 0.52, 0.99, 0.98, 0.97)]
    cap = assign.capacity(5, 2, 0)
    done = assign.assign_round(frame(spark, probs), 2, cap, "input")
    got = assign.level_diagnostics(done).first()
    assert (got["num_vectors"], got["denied_top_count"], got["mean_chosen_rank"], got["fallback_count"]) == (5, 2, 0.4, 0)
    hist = assign.rank_histogram(done)
    assert {r["bucket"]: r["n_vectors"] for r in hist.collect() if r["n_vectors"]} == {"rank_0": 3, "rank_1": 2}
    assert assign.min_top_r(hist).first()[0] == 2
    confident = assign.assign_round(frame(spark, probs), 2, cap, "confidence")
    assert {i for i, (b, *_) in enumerate(placed(confident)) if b == 0} == {2, 3, 4}


@pytest.mark.parametrize("ranks, want", [([0] * 999 + [40], 1), ([0] * 500 + [20] * 500, 32), ([], 0)])
def test_covering_rank(spark, ranks, want):
    rows = spark.createDataFrame([(r, False) for r in ranks], "chosen_rank int, used_fallback boolean")
    assert assign.min_top_r(assign.rank_histogram(rows)).first()[0] == want


def test_histogram_buckets(spark):
    rows = spark.createDataFrame([(r, False) for r in (0, 0, 1, 3, 4, 7, 8, 300)] + [(9, True)], "chosen_rank int, used_fallback boolean")
    got = {r["bucket"]: r["n_vectors"] for r in assign.rank_histogram(rows).collect() if r["n_vectors"]}
    assert got == {"rank_0": 2, "rank_1": 1, "rank_3": 1, "rank_4_7": 2, "rank_8_15": 1, "rank_256_plus": 1}


def test_capacity_and_balance(spark):
    rng = random.Random(9)
    probs = [[rng.random() for _ in range(4)] for _ in range(61)]
    got = placed(assign.assign_round(frame(spark, probs), 4, assign.capacity(61, 4, 0)))
    sizes = [sum(b == x for x, *_ in got) for b in range(4)]
    assert max(sizes) <= 16 and sum(sizes) == 61 and not any(f for *_, f in got)


def plain_sequential(probs, k, cap, order):
    score = {"confidence": max, "margin": lambda p: sorted(p)[-1] - sorted(p)[-2], "input": lambda p: 0}[order]
    counts, out = [0] * k, {}
    for i in sorted(range(len(probs)), key=lambda i: (-score(probs[i]), i)):
        wanted = sorted(range(k), key=lambda b: (-probs[i][b], b))
        free = [r for r, b in enumerate(wanted) if counts[b] < cap]
        b = wanted[free[0]] if free else counts.index(min(counts))
        counts[b] += 1
        out[i] = (b, free[0] if free else k, not free)
    return [out[i] for i in range(len(probs))]


@pytest.mark.parametrize("n, k, cap, order", [(300, 4, 75, "confidence"), (200, 5, 30, "input"), (9000, 3, 3000, "confidence")])
def test_sequential_equals_plain_version_without_a_serial_task(spark, n, k, cap, order):
    rng = random.Random(n)
    probs = [[rng.randrange(1, 9) * (3 if b == 0 else 1) / 32 for b in range(k)] for _ in range(n)]
    done = assign.assign_sequential(frame(spark, probs), k, cap, order)
    assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().toString()
    assert placed(done) == plain_sequential(probs, k, cap, order)


def test_a_step_that_holds_all(spark):
    """Scores that are all alike: the queue's order is that of what was tried and of ids, over many ranges."""
    probs = [[0.5, 0.3, 0.2] if i % 3 else [0.3, 0.5, 0.2] for i in range(200)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert placed(assign.assign_round(frame(spark, probs), 3, 67, finish_rows=0)) == plain_rounds(probs, 3, 67, "confidence")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_places_in_groups(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([[], [1], [1, 2]]), rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, p array<int>, s int, i long").repartition(6)
    got = {r["i"]: r["n"] for r in places(df, ["g", "p"], [F.desc("s"), F.col("i")], "n").collect()}
    for g in ("a", "b", None):
        for p in ([], [1], [1, 2]):
            own = sorted((-s, i) for gg, pp, s, i in rows if (gg, pp) == (g, p))
            assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert places(df.limit(0), ["g"], [F.col("i")]).count() == 0
