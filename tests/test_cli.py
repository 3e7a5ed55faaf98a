"""Whole runs from the command line, over vector files."""

import json
import struct

import numpy as np
import pytest

from vecroute.cli import main, parser

SETTINGS = """
experiment: {{name: small, seed: 3, output_dir: {out}}}
dataset: {{name: made, path: {data}}}
model: {{branching_factor: 3, tree_height: 2, embedding_dim: 4, num_trees: 2, ff_dim: 8, alpha: {alpha}}}
training: {{top_k_neighbors: 5, neighbor_search_subset: 1000, query_fraction: 0.3, max_alternating_cycles: 1}}
evaluation: {{beam_size: 9, num_leaves: [2, 9], num_queries: 6}}
"""


@pytest.fixture
def files(tmp_path):
    m = np.random.default_rng(2).normal(0, 1, (150, 4)).astype("<f4")
    data = tmp_path / "data"
    data.mkdir()
    (data / "base.fbin").write_bytes(struct.pack("<ii", *m.shape) + m.tobytes())
    (data / "query.fbin").write_bytes(struct.pack("<ii", 10, 4) + m[:10].tobytes())

    def settings(alpha=1.0):
        path = tmp_path / "run.yaml"
        path.write_text(SETTINGS.format(out=tmp_path / "out", data=data, alpha=alpha))
        return str(path)

    return tmp_path, settings


def test_build_search_and_estimate(spark, files):
    tmp_path, settings = files
    out, log = tmp_path / "out", tmp_path / "run.log"
    assert main(["build", settings(), "--diagnostics", "--diagnostics-queries", "4", "--diagnostics-pairs", "50", "--batch-train", "32", "--batch-tree-update", "40", "--log", str(log)]) == 0
    rows = spark.read.json(str(out / "cycle-diagnostics")).collect()
    assert sorted((r["tree"], r["cycle"], r["stage"]) for r in rows) == [(t, 0, s) for t in (0, 1) for s in ("router", "tree")]
    assert {r["queries"] for r in rows} == {4} and {r["loss_pairs"] for r in rows} == {50}
    assert "tree 1: 1 cycles" in log.read_text()
    machines = json.loads((out / "environment.json").read_text())
    assert machines["executors"] and machines["driver"]["cores"] >= 1

    assert main(["search", settings(), "--batch-search", "3", "--n-queries", "5"]) == 0
    few, full = json.loads((out / "metrics.json").read_text())
    assert full["recall@10"] == 1.0 and full["mean_distcomp"] == 150 and few["mean_distcomp"] < 150 and full["n_queries"] == 5

    assert main(["estimate", settings()]) == 0
    assert json.loads((out / "estimate.json").read_text())["build_seconds"] > 0


def test_unfit_settings_stop_a_run(spark, files, caplog):
    _, settings = files
    with pytest.raises(ValueError, match="alpha"):
        main(["build", settings(0.9)])
    with pytest.raises(ValueError, match="alpha"):
        main(["search", settings(0.9)])
    assert main(["build", settings(0.9), "--skip-sanity-checks", "--tree-index", "0"]) == 0
    assert "unchecked settings: model.alpha" in caplog.text


def test_fetch_and_convert(spark, files):
    tmp_path, _ = files
    assert main(["fetch", str(tmp_path / "data" / "base.fbin"), str(tmp_path / "slice"), "--rows", "60", "--piece-rows", "25", "--suffix", ".fbin"]) == 0
    assert main(["convert", str(tmp_path / "slice"), str(tmp_path / "rows")]) == 0
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 60
    assert set(spark.read.json(str(tmp_path / "rows-manifest")).columns) == {"file", "bytes", "sha256", "md5"}
    for wrong in (["fetch", "a", "b", "--rows", "0"], ["build", "x", "--batch-train", "-1"]):
        with pytest.raises(SystemExit):
            parser().parse_args(wrong)
