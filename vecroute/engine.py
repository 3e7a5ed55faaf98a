"""Building, searching and merging indexes as whole runs."""

from __future__ import annotations

import json
import logging
import os
import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.config import Config
from vecroute.functions.distance import l2_normalize
from vecroute.functions.storage import exists, materialise, write_text
from vecroute.operators import knn, metrics
from vecroute.operators.experiments import executor_peaks
from vecroute.operators.search import beam_search, vector_cells
from vecroute.operators.training import Probe, Sink, alternating_train
from vecroute.sources import index as index_io
from vecroute.sources.vectors import first_existing, normalise_truth, read_hdf5, read_vectors, truth_long

LOG = logging.getLogger("vecroute")

# Names under which data sets keep their files, in the order in which they are looked for.
SUFFIXES = (".fvecs", ".fbin", ".f32bin", ".u8bin", ".i8bin", ".npy", ".hdf5", ".h5")
QUERY_NAMES = ("queries", "query", "query.public.10K", "query.public.10k", "query.10K", "query.10k", "query.30K", "query.30k")
TRUTH_NAMES = (
    "groundtruth", "groundtruth.10K", "groundtruth.10k", "groundtruth.30K", "groundtruth.30k", "idx_100M", "idx_100m", "gnd/idx_100M", "gnd/idx_100m", "ground_truth", "gt",
)
TRUTH_SUFFIXES = (".ivecs", ".ibin", ".i32bin", ".npy")
#: Data sets whose neighbour files may be transposed or count from 1.
ODD_TRUTH = {"laion5b", "laion5b_subset"}


def load_database(spark: SparkSession, cfg: Config) -> DataFrame:
    d = cfg.dataset
    inside = [f"{d.path}/{n}{s}" for n in (d.split, "vectors", "base", "base.100M", "base.100m") for s in SUFFIXES]
    path = d.base_path or (d.path if _is_file(d.path) else first_existing(spark, [*(f"{d.path}{s}" for s in SUFFIXES), *inside, d.path]))
    rows = spark.read.parquet(path) if path.endswith(".parquet") else read_vectors(spark, path, d.subset_size)
    return _prepared(rows.select("vec_id", "embedding"), cfg)


def load_queries(spark: SparkSession, cfg: Config) -> tuple[DataFrame, DataFrame | None]:
    """(queries, ground truth or None): the first ``num_queries`` of the query file."""
    d, n = cfg.dataset, cfg.evaluation.num_queries
    both = d.path.endswith((".hdf5", ".h5")) and not d.query_path and not d.ground_truth_path
    if both:  # one file with the data sets ``test`` and ``neighbors``
        raw, near = read_hdf5(spark, d.path, "test"), read_hdf5(spark, d.path, "neighbors")
    else:
        asked = d.query_path or first_existing(spark, [f"{d.path}/{q}{s}" for q in QUERY_NAMES for s in SUFFIXES])
        raw = spark.read.parquet(asked) if asked.endswith(".parquet") else read_vectors(spark, asked)
        known = d.ground_truth_path or next((p for q in TRUTH_NAMES for s in TRUTH_SUFFIXES if exists(spark, p := f"{d.path}/{q}{s}")), None)
        near = read_vectors(spark, known) if known else None
    queries = _prepared(raw.where(F.col("vec_id") < n).select("vec_id", "embedding"), cfg).withColumnRenamed("vec_id", "query_id")
    if near is None:
        return queries, None
    truth = truth_long(near)
    if d.name in ODD_TRUTH:
        truth = normalise_truth(truth, raw.count())
    return queries, truth.where(F.col("query_id") < n)


def _is_file(path: str) -> bool:
    return path.endswith((*SUFFIXES, ".parquet"))


def _prepared(rows: DataFrame, cfg: Config) -> DataFrame:
    return rows.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>")) if cfg.dataset.normalize else rows


def probe(spark: SparkSession, cfg: Config, vectors: DataFrame, top_k: int = 10, most: int | None = None) -> Probe:
    """The queries of the settings (at most ``most``) with their true neighbours, for trying a tree after each cycle."""
    queries, truth = load_queries(spark, cfg)
    real = truth if truth is not None else knn.exact_knn(queries, vectors, top_k, cfg.metric())
    return Probe(queries, materialise(real, "truth"), cfg.evaluation.beam_size, max(cfg.evaluation.num_leaves), top_k, most)


def tree_name(cfg: Config, tree: int) -> str:
    """Trees made under other rules than the usual have names of their own."""
    rules = (cfg.experiment.tree_assignment_mode, cfg.experiment.tree_assignment_order)
    return f"tree-{tree}" if rules == ("round", "confidence") else f"tree-{tree}-{'-'.join(rules)}"


def build(spark: SparkSession, cfg: Config, vectors: DataFrame, index_path: str, tree_index: int | None = None, probe: Probe | None = None, sink: Sink | None = None, **changed) -> dict:
    """Train the trees (or one of them) and save each below ``index_path`` as it is done; trees that are
    there already are kept, so a run that broke off goes on. All trees there are become one index. ``changed``
    are training settings in place of those of ``cfg``."""
    n = vectors.count()
    settings = replace(cfg.train_settings(), **{name: value for name, value in changed.items() if value is not None})
    wanted = range(cfg.model.num_trees) if tree_index is None else [tree_index]
    log = []
    for t in wanted:
        path = f"{index_path}/{tree_name(cfg, t)}"
        if exists(spark, f"{path}/meta.json"):
            continue
        began = time.perf_counter()
        router, paths, cycles = alternating_train(vectors, settings, t, probe, sink)
        meta = index_io.IndexMeta(cfg.model.branching_factor, cfg.model.tree_height, cfg.model.alpha, n, 1)
        index_io.save_index(paths.withColumn("tree_id", F.lit(0)), router.table(spark), meta, path)
        LOG.info("tree %d: %d cycles in %.1f s, last loss %.4f", t, len(cycles), time.perf_counter() - began, cycles[-1]["loss"])
        log.append({"tree": t, "seconds": time.perf_counter() - began, "cycles": cycles})
    ready = [f"{index_path}/{tree_name(cfg, t)}" for t in range(cfg.model.num_trees)]
    if tree_index is None and not exists(spark, f"{index_path}/index"):
        index_io.merge_indexes(spark, ready, f"{index_path}/index")
    return {"vectors": n, "trees": log}


def sweep(spark: SparkSession, cfg: Config, vectors: DataFrame, queries: DataFrame, truth: DataFrame | None, index_path: str, top_k: int = 10) -> list[dict]:
    """A row per leaf budget: recall, candidates, throughput and bounds, from a single beam."""
    m, e = cfg.model, cfg.evaluation
    paths, router, meta = index_io.load_index(spark, index_path, m.branching_factor, m.tree_height, n_trees=m.num_trees)
    real = truth if truth is not None else knn.exact_knn(queries, vectors, top_k, cfg.metric())
    real = materialise(real, "truth")
    times = []
    for _ in range(e.search_repetitions):
        began = time.perf_counter()
        beam = materialise(beam_search(queries, router, meta.k, meta.h, e.beam_size, max(e.num_leaves)), "beam")
        times.append((0, time.perf_counter() - began))
    timed = metrics.repetition_summary(spark.createDataFrame(times, "point int, seconds double"), ["point"]).first()
    exact, bound = metrics.routing_evals(m.num_trees, meta.k, meta.h, e.beam_size)
    leaves_of = sorted(set(e.num_leaves))
    asked, rows = queries.count(), []
    began = time.perf_counter()
    results, _ = metrics.sweep_results(beam, paths, queries, vectors, leaves_of, m.num_trees, top_k, e.min_trees, cfg.metric())
    results = materialise(results, "results")
    seconds_all = time.perf_counter() - began
    budgets = spark.createDataFrame([(x,) for x in leaves_of], "num_leaves int")
    per_query = materialise(metrics.recall_per_query(results, real, top_k, budgets), "recall")
    recalls = {r["num_leaves"]: r for r in metrics.recall_stats(per_query, ["num_leaves"]).collect()}  # a row a budget
    held = metrics.sweep_counts(beam, vector_cells(paths), queries, leaves_of, m.num_trees, e.min_trees)
    n = F.col("n_candidates")
    sums = {r["num_leaves"]: r for r in held.groupBy("num_leaves").agg(F.sum(n).alias("n"), F.sum(n * n).alias("squares")).collect()}
    pairs = max(1, sum(r["n"] for r in sums.values()))
    for leaves in leaves_of:
        recall, n, squares = recalls[leaves], *((sums[leaves]["n"], sums[leaves]["squares"]) if leaves in sums else (0, 0))
        counts = {"mean": n / asked, "std": max(0.0, squares / asked - (n / asked) ** 2) ** 0.5}
        # budgets are measured together: each has the share of the time that it has of the pairs
        seconds = seconds_all * n / pairs + timed["median"]
        one, all_ = metrics.candidate_bounds(meta.n, m.num_trees, meta.k, meta.h, leaves)
        rows.append({
            "method": "vecroute", "dataset": cfg.dataset.name, "model_id": f"K{meta.k}_H{meta.h}", "config": cfg.experiment.name, "seed": cfg.experiment.seed,
            "beam_size": e.beam_size, "num_trees": m.num_trees, "min_trees": e.min_trees or min(2, m.num_trees),
            "tree_assignment_mode": cfg.experiment.tree_assignment_mode, "tree_assignment_order": cfg.experiment.tree_assignment_order,
            "label_refresh": cfg.training.label_refresh, "knob_name": "num_leaves", "knob_value": leaves, f"recall@{top_k}": recall["mean"],
            f"recall@{top_k}_zero_count": recall["zero_count"], f"recall@{top_k}_below_half_count": recall["below_half_count"],
            **{f"recall@{top_k}_{p}_quantile": recall[p] for p in ("p5", "p25", "p50", "p75", "p95")},
            "mean_distcomp": counts["mean"], "std_n_distcomp": counts["std"],
            "estimated_candidate_set_size": metrics.candidate_set_estimate(paths, meta.k, meta.h, leaves).first()[0],
            "routing_evals_exact": exact, "routing_evals_bound": bound, "mean_total_work_bound": counts["mean"] + bound, "n_queries": asked,
            "search_time_s": seconds, "qps": asked / seconds, "index_size_mb": index_io.index_size_mb(spark, index_path), "index_path": index_path,
            "tree_candidate_bound": one, "candidate_bound": all_, "beam_repetitions": timed["repetitions"], "beam_min_s": timed["min"], "beam_max_s": timed["max"],
        })
    return rows


def write_rows(spark: SparkSession, output_dir: str, stem: str, rows: list[dict]) -> None:
    """``stem.json``, and ``stem.csv`` unless there are no rows."""
    import csv
    import io

    plain = [{k: v.item() if hasattr(v, "item") else v for k, v in r.items()} for r in rows]
    write_text(spark, f"{output_dir}/{stem}.json", json.dumps(plain, indent=1, default=str))
    if plain:
        text = io.StringIO()
        out = csv.DictWriter(text, list(plain[0]))
        out.writeheader()
        out.writerows(plain)
        write_text(spark, f"{output_dir}/{stem}.csv", text.getvalue())


def write_run(spark: SparkSession, cfg: Config, output_dir: str) -> None:
    """What a run needs to be told from others: its settings, its seed, and where it ran."""
    write_text(spark, f"{output_dir}/config.json", json.dumps(asdict(cfg), indent=1, default=str))
    write_text(spark, f"{output_dir}/seed.txt", f"{cfg.experiment.seed}\n")
    write_text(spark, f"{output_dir}/environment.json", json.dumps(run_metadata(spark), indent=1))


def run_metadata(spark: SparkSession) -> dict:
    """Versions, and the machines that Spark runs on, as it knows them."""
    import platform

    conf = spark.sparkContext.getConf()
    machine = {"host": platform.node(), "system": platform.platform(), "processor": platform.machine(), "cores": os.cpu_count()}
    sizes = {k: conf.get(f"spark.{k}", None) for k in ("executor.instances", "executor.cores", "executor.memory", "driver.memory")}
    seen = {"executors": executor_peaks(spark)}
    return {"spark": spark.version, "python": platform.python_version(), "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "driver": machine} | sizes | seen
