import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecroute import engine
from vecroute.config import from_mapping
from vecroute.operators import analysis, knn, training

RAW = {
    "experiment": {"name": "small", "seed": 3, "output_dir": "out"},
    "dataset": {"name": "made", "path": "none"},
    "model": {"branching_factor": 3, "tree_height": 2, "embedding_dim": 4, "num_trees": 2},
    "training": {"top_k_neighbors": 5, "neighbor_search_subset": 1000, "query_fraction": 0.2, "max_alternating_cycles": 1},
    "evaluation": {"beam_size": 9, "num_leaves": [1, 9], "num_queries": 5},
}


def test_build_search_and_merge(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(5)], "query_id long, embedding array<float>")
    cfg = from_mapping(RAW)
    log = engine.build(spark, cfg, vectors, str(tmp_path))
    assert len(log["trees"]) == 2 and all(len(t["cycles"][0]["levels"]) == 2 for t in log["trees"])
    assert engine.build(spark, cfg, vectors, str(tmp_path))["trees"] == []  # all there already
    few, full = engine.sweep(spark, cfg, vectors, queries, None, f"{tmp_path}/index")
    assert full["recall@10"] == 1.0 and full["mean_distcomp"] == 120 and few["mean_distcomp"] < 120
    engine.write_rows(spark, str(tmp_path), "metrics", [{**few, "n": np.int64(3)}, full])
    engine.write_run(spark, cfg, str(tmp_path))
    assert (tmp_path / "seed.txt").read_text() == "3\n" and json.loads((tmp_path / "config.json").read_text())["experiment"]["name"] == "small"
    back = json.loads((tmp_path / "metrics.json").read_text())
    assert len(back) == 2 and back[0]["n"] == 3 and back[1]["std_n_distcomp"] == 0 and back[1]["recall@10_p5_quantile"] == 1.0
    curve = analysis.read_curve(spark, str(tmp_path / "metrics.csv"), "x")
    assert sorted(r["leaves"] for r in curve.collect()) == [1, 9]


def test_balance_of_training(spark):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(80)], "vec_id long, embedding array<float>")
    s = training.TrainSettings(4, 2, query_fraction=0.3, top_k=4, max_cycles=2, patience=1)
    _, paths, cycles = training.alternating_train(vectors, s)
    sizes = [r["count"] for r in paths.groupBy("leaf_id").count().collect()]
    assert sum(sizes) == 80 and max(sizes) <= 5 and 1 <= len(cycles) <= 2
    assert cycles[0]["levels"][0]["rank_hist_0"] + cycles[0]["levels"][0]["rank_hist_1"] <= 80 and "recall" not in cycles[0]
    asked = vectors.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    probe = training.Probe(asked, knn.exact_knn(asked, vectors, 3), 16, 16, 3)
    few = training.TrainSettings(4, 2, query_fraction=0.3, top_k=4, max_cycles=1, loss_pairs=10)
    _, _, cycles = training.alternating_train(vectors, few, probe=probe)
    assert cycles[0]["recall"] == 1.0 and cycles[0]["mean_candidates"] == 80
    assert training.improvement(None, 1.0) is None and training.improvement(2.0, 1.0) == 0.5


def test_settings_fit_for_a_run():
    def with_(**values):
        return from_mapping(RAW).override(**values)

    assert with_().problems() == [] and with_().checked() == with_()
    wrong = {
        "alpha": {"model__alpha": 0.5}, "num_heads": {"model__num_heads": 7}, "num_epochs": {"training__num_epochs": 4}, "top_r must be 2": {"training__tree_update_top_r": 1},
        "neighbor_search_backend": {"training__neighbor_search_backend": "none"}, "rerank_backend": {"evaluation__rerank_backend": "none"},
        "cache_embeddings": {"training__tree_update_cache_embeddings": "perhaps"},
        "sequential": {"experiment__tree_assignment_mode": "sequential", "training__tree_update_top_r": 2},
    }
    for word, values in wrong.items():
        with pytest.raises(ValueError, match=word):
            with_(**values).checked()
        assert with_(**values).checked(skip=True) == with_(**values)
    assert with_(experiment__tree_assignment_mode="sequential", training__tree_update_top_r=3).checked()


def test_settings_are_checked():
    def broken(section, **values):
        raw = {k: dict(v) for k, v in RAW.items()}
        raw.setdefault(section, {}).update(values)
        with pytest.raises(ValueError) as e:
            from_mapping(raw)
        return str(e.value)

    assert "did you mean 'beam_size'" in broken("evaluation", beamsize=3)
    assert "did you mean 'model'" in broken("modell", x=1)
    broken("evaluation", num_leaves=[10])
    broken("evaluation", min_trees=3)
    broken("experiment", seed=-1)
    broken("model", encoder_hidden=12)
    broken("training", top_k_neighbors=2000)
    cfg = from_mapping(RAW).override(evaluation__num_leaves=[2], dataset__path=None)
    assert cfg.evaluation.num_leaves == [2] and cfg.dataset.path == "none"


def test_series_of_curves(spark, tmp_path):
    (tmp_path / "a.csv").write_text("method,model_id,config,knob_value,recall@10,mean_distcomp\nm,x,,1,0.5,10\nm,y,,1,0.6,20\n")
    (tmp_path / "b.csv").write_text("knob_value,recall@10,mean_distcomp\n")
    assert sorted(r["label"] for r in analysis.read_curve(spark, str(tmp_path / "a.csv")).collect()) == ["m:x", "m:y"]
    with pytest.raises(ValueError, match="no rows"):
        analysis.read_curve(spark, str(tmp_path / "b.csv"))
    other = from_mapping({**RAW, "experiment": {**RAW["experiment"], "tree_assignment_order": "input"}})
    assert engine.tree_name(from_mapping(RAW), 1) == "tree-1" and engine.tree_name(other, 1) == "tree-1-round-input"


def curve(spark, points):
    return spark.createDataFrame([("x", i, float(r), float(c), None) for i, (r, c) in enumerate(points)], analysis.CURVE_SCHEMA)


def test_interpolation_and_drift(spark):
    rng = random.Random(8)
    points = sorted((rng.random(), 100 * rng.random()) for _ in range(9))
    c = curve(spark, points)
    goals = [points[0][0] / 2, *(rng.uniform(points[0][0], points[-1][0]) for _ in range(6)), points[4][0], 1.5]
    got = {r["target"]: r["candidates"] for r in analysis.candidates_at_recall(c, goals).collect()}
    for g in goals:
        want = np.interp(g, *zip(*points, strict=True)) if points[0][0] <= g <= points[-1][0] else None
        assert got[g] == (want if want is None else pytest.approx(want))
    rows = [(x, leaves, 0.1 * leaves, 40.0 * leaves * (1 + (leaves > 3 and x == "b")), 1.0) for leaves in range(1, 7) for x in "ab"]
    both = spark.createDataFrame(rows, analysis.CURVE_SCHEMA)
    assert sorted(r["leaves"] for r in analysis.balance_warnings(both, "a", "b").collect()) == [4, 5, 6]
    shifts = analysis.compare(both, "a", "b").orderBy("target").collect()
    assert len(shifts) == 5 and shifts[0]["change"] == pytest.approx(0) and shifts[-1]["change"] == pytest.approx(1)
    side = analysis.by_leaves(both, "a", "b").collect()
    assert len(side) == 6 and all(r["delta"] == pytest.approx(0) for r in side)
    apart = both.withColumn("recall", F.when(F.col("label") == "a", 0.2).otherwise(0.2))
    assert analysis.recall_targets(apart, "a", "b") == []
    with pytest.raises(ValueError):
        analysis.recall_targets(both, "a", "c")


def job(host, card, *points):
    """A log as a batch job leaves it: its own line, the device table, progress, and a block a point."""
    lines = [f"Job 77.queue on {host} at Monday", "copying", "+---+", f"|   0  {card}           On  |   0:61 Off |   0 |", "K4_H2: queries done 5/10, 31.5 q/s"]
    return "\n".join([*lines, *(f"=== next ===\n{json.dumps(p, indent=2)}" for p in points), "Done."])


def test_logs(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    one = {"config": "first", "beam_size": 7, "num_trees": 3, "knob_value": 5, "recall@10_zero_count": 2, "recall@10": 0.31, "mean_distcomp": 900.5, "qps": 12.5}
    two = {"model_id": "second", "recall@100": 0.72, "qps": 8}
    (tmp_path / "deep" / "a.log").write_text(job("node4.lab", "NVIDIA T1000", one, two))
    (tmp_path / "b.out").write_text(job("node9.lab", "NVIDIA RTX 9 Ultra B...", {**one, "qps": 99.0}))
    (tmp_path / "c.json").write_text(json.dumps({"rows": [{"qps": 4.0, "recall@10": 0.0, "knob_value": 1}], "note": {"x": 1}}))
    (tmp_path / "cut.txt").write_text('{"qps": 1.5, "recall@10": 0.5}\n{"qps": 2.5, "recall@10":\n')
    (tmp_path / "notes.md").write_text('{"qps": 1000}')
    rows = analysis.scan_logs(spark, str(tmp_path)).collect()
    got = sorted((r["qps"], r["recall"], r["knob"], r["config"], r["host"], r["gpu"]) for r in rows)
    assert got == sorted([
        (12.5, 0.31, 5, "first", "node4.lab", "NVIDIA T1000"), (8.0, 0.72, None, "second", "node4.lab", "NVIDIA T1000"),
        (99.0, 0.31, 5, "first", "node9.lab", "NVIDIA RTX 9 Ultra B..."), (4.0, 0.0, 1, "", None, None), (1.5, 0.5, None, "", None, None),
    ])
    kept = analysis.filter_measurements(analysis.scan_logs(spark, str(tmp_path)), min_recall=0.6)
    assert [r["best_qps"] for r in analysis.qps_by_machine(kept).collect()] == [8.0]
    best = {r["host"]: r["best_candidates_per_second"] for r in analysis.qps_by_machine(analysis.scan_logs(spark, str(tmp_path))).collect()}
    assert best["node4.lab"] == pytest.approx(12.5 * 900.5)


def test_points_are_an_object_and_its_rows(spark, tmp_path):
    nested = {"qps": 3, "best": {"qps": 9}, "rows": [{"qps": 1, "more": {"qps": 2}}, {"x": 1}, 5], "deep": [{"qps": 7}]}
    (tmp_path / "a.json").write_text(json.dumps(nested) + '\n{"qps": "no number", "beam_size": 4.0, "recall@10_p5_quantile": 0.5}')
    rows = analysis.scan_logs(spark, str(tmp_path)).collect()
    assert sorted(((r["qps"], r["beam"], r["recall"]) for r in rows), key=repr) == [(1.0, None, None), (3.0, None, None), (None, 4, None)]


def test_objects_in_free_text():
    assert analysis._objects('x {not json} {"a": 1, "b": {"c": "}"}} {"q": 2, "r":\n {"z": 3} "') == [{"a": 1, "b": {"c": "}"}}, {"z": 3}]
    assert analysis._objects("") == analysis._objects("}{ [1]") == []


def test_chart(spark):
    svg = analysis.render_svg(curve(spark, [(0.5, 1000), (0.7, 2000)]))
    assert svg.startswith("<svg") and "polyline" in svg
    assert "polyline" not in analysis.render_svg(curve(spark, [(0.5, 1)]).limit(0))
