import random
from dataclasses import replace

import pytest

from vecroute import engine
from vecroute.functions.paths import random_init
from vecroute.functions.storage import exists, materialise, shared_dir, temporary
from vecroute.operators import experiments, knn, search, training
from vecroute.operators.router import centroid_router
from vecroute.streaming.serve import serve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = shared_dir(spark, "vectors")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_arms_against_their_source(spark, vectors):
    s = training.TrainSettings(2, 2, query_fraction=0.5, top_k=3, max_cycles=1)
    router, paths, _ = training.alternating_train(vectors, s)
    arms = [experiments.Arm("own", "round", "confidence"), experiments.Arm("other", "sequential", "input")]
    rows = {r["arm"]: r for r in experiments.reassign_arms(router, vectors, paths, s, arms, drift=0.001).collect()}
    assert rows["own"]["moved"] == 0 and rows["other"]["n_vectors"] == 60 and all(r["max"] <= 15 for r in rows.values())
    shuffled = random_init(vectors, 2, 2, 5)
    with pytest.raises(ValueError):
        experiments.reassign_arms(router, vectors, shuffled, s, arms[:1], drift=0.001)


def test_ablation_and_diagnostics(spark):
    s = training.TrainSettings(2, 2)
    found = experiments.ablation(s, alpha=[1.0, 2.0], label_refresh=["once", "per_cycle"])
    assert len(found) == 4 and found["alpha-2.0_label_refresh-once"].alpha == 2.0


class Broken(Exception):
    pass


def test_diagnostics_of_a_run_that_breaks_off(spark, vectors):
    """What is done by then is on disk; the run that goes on replaces what it does anew."""
    path = shared_dir(spark, "diagnostics")
    write = experiments.diagnostics_sink(spark, path)

    def until(row):
        write(row)
        if (row["cycle"], row["stage"]) == (1, "router"):
            raise Broken

    asked = vectors.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    probe = training.Probe(asked, knn.exact_knn(asked, vectors, 3), 4, 4, 3, most=5)
    s = training.TrainSettings(2, 2, query_fraction=0.5, top_k=3, max_cycles=3, max_iter=5, hidden=4, loss_pairs=20)
    with pytest.raises(Broken):
        training.alternating_train(vectors, s, probe=probe, sink=until)
    rows = {(r["cycle"], r["stage"]): r for r in spark.read.json(path).collect()}
    assert sorted(rows) == [(0, "router"), (0, "tree"), (1, "router")]
    assert all(r["recall"] == 1.0 and r["queries"] == 5 and r["mean_candidates"] == 60 and r["loss_pairs"] == 20 for r in rows.values())
    assert len(rows[0, "tree"]["levels"]) == 2 and rows[0, "tree"]["leaf_gini"] == pytest.approx(0)
    training.alternating_train(vectors, replace(s, max_cycles=1), sink=write)
    assert spark.read.json(path).count() == 3


def test_estimate(spark, vectors):
    found = experiments.estimate_runtime(vectors, training.TrainSettings(2, 1, query_fraction=0.5, top_k=3, max_iter=3, hidden=2), 4, 10)
    assert found["build_seconds"] == pytest.approx(40 * found["cycle_seconds"])
    assert found["executors"] and all(e["cores"] > 0 and e["most_memory"] > 0 and set(experiments.PEAKS) <= set(e) for e in found["executors"])
    meta = engine.run_metadata(spark)
    assert meta["executors"] and meta["driver"]["cores"] >= 1


def test_manifest(spark, vectors):
    path = shared_dir(spark, "converted")
    known = experiments.convert_with_manifest(vectors, path)
    assert known.count() >= 1 and experiments.verify_manifest(spark, path, known).count() == 0
    import hashlib

    for r in known.collect():
        with open(f"{path}/{r['file']}".removeprefix("file:"), "rb") as f:
            assert r["md5"] == hashlib.md5(f.read()).hexdigest()
    changed = known.withColumn("sha256", known["file"])
    assert experiments.verify_manifest(spark, path, changed).count() == known.count()
    with pytest.raises(Exception):
        experiments.convert_with_manifest(vectors, path)


def test_stream_of_queries_equals_batch(spark, vectors):
    trees = random_init(vectors, 2, 2)
    parts = trees.join(vectors, "vec_id").selectExpr("tree_id", "explode(array(struct(slice(path, 1, 0) p, path[0] b), struct(slice(path, 1, 1) p, path[1] b))) s", "embedding")
    router = centroid_router(parts.selectExpr("tree_id", "s.p prefix", "s.b branch", "embedding"))
    source, out, mark = (shared_dir(spark, x) for x in ("asked", "answers", "mark"))
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    asked.write.parquet(source)
    stream = spark.readStream.schema(asked.schema).parquet(source)
    q = serve(stream, router, trees, vectors, out, mark, 2, 2, 1, 4, 5)
    q.processAllAvailable()
    q.stop()
    want, _ = search.search(asked, router, trees, vectors, 2, 2, 1, 4, 5)
    got = spark.read.parquet(out).select("query_id", "rank", "vec_id", "distance")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15


def test_tables_of_a_block_go_when_it_ends(spark):
    with temporary(spark):
        gone = materialise(spark.range(3), "gone")
        with temporary(spark):
            inner = materialise(gone, "inner", keep=True)
        kept = materialise(inner.where("id > 0"), "kept", keep=True)
    after = materialise(spark.range(2), "after")
    assert kept.count() == 2 and inner.count() == 3 and after.count() == 2
    assert not exists(spark, gone.inputFiles()[0].rsplit("/", 1)[0])
