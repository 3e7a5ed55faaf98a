"""Alternating training: mine neighbours, fit a router, reassign all vectors under capacities."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.functions.paths import checked_path, path_to_leaf, random_init, shuffled_rank
from vecroute.functions.storage import materialise
from vecroute.operators import metrics, search
from vecroute.operators.assign import assign_round, assign_sequential, capacity, level_report, next_level
from vecroute.operators.knn import linspace_sample, mine_labels, sample_ids
from vecroute.operators.router import node_probs
from vecroute.operators.shared_router import SharedRouter, fit_shared, pair_losses


@dataclass(frozen=True)
class TrainSettings:
    k: int
    h: int
    alpha: float = 1.0
    top_k: int = 10
    query_fraction: float = 0.01
    subset_size: int | None = None
    max_cycles: int = 3
    min_delta: float = 1e-3
    patience: int | None = None
    metric: str = "euclidean"
    mode: str = "round"
    order: str = "confidence"
    label_refresh: str = "per_cycle"
    seed: int = 0
    max_iter: int = 60
    hidden: int = 64
    block_rows: int = 128
    loss_pairs: int = 1_000_000

    def __post_init__(self):
        if self.mode not in ("round", "sequential"):
            raise ValueError("mode must be round or sequential")
        if self.label_refresh not in ("once", "per_cycle"):
            raise ValueError("label_refresh must be once or per_cycle")
        if self.k < 2 or self.h < 1:
            raise ValueError("a tree needs k >= 2 and h >= 1")
        if self.max_cycles < 1 and self.patience is None:
            raise ValueError("unbounded training needs patience")


def training_pairs(queries: DataFrame, neighbours: DataFrame, tree_paths: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, embedding, path): each query once per neighbour, with that neighbour's path as label.

    A neighbour that the tree doesn't hold is an error, and with ``k`` so is a path with a branch that is none."""
    missing = F.raise_error(F.concat(F.lit("neighbour "), F.col("vec_id").cast("string"), F.lit(" isn't in the tree"))).cast("array<int>")
    labels = neighbours.join(tree_paths.select("vec_id", "path"), "vec_id", "left").select("query_id", "rank", F.coalesce("path", missing).alias("path"))
    if k is not None:
        labels = labels.withColumn("path", checked_path(F.col("path"), k))
    return labels.join(queries, "query_id").select("query_id", "rank", "embedding", "path")


def fit_router(pairs: DataFrame, settings: TrainSettings, start: SharedRouter | None = None) -> SharedRouter:
    """The sum over levels of cross-entropy given the true path so far, all levels in one network."""
    return fit_shared(pairs, settings.k, settings.h, settings.hidden, settings.max_iter, settings.seed, start, settings.block_rows)


def training_loss(router: SharedRouter, pairs: DataFrame) -> float:
    """Mean over pairs of the levels' summed cross-entropy."""
    return float(pair_losses(router, pairs).agg(F.avg("loss")).first()[0])


def sampled_loss(router: SharedRouter, pairs: DataFrame, settings: TrainSettings) -> tuple[float, int]:
    """(``training_loss`` over at most ``loss_pairs`` pairs, evenly spaced over all of them; how many)."""
    n = pairs.count()
    if n <= settings.loss_pairs:
        return training_loss(router, pairs), n
    ranked = shuffled_rank(pairs.select(F.struct("query_id", "rank").alias("pair"), "embedding", "path").withColumn("key", F.col("pair").cast("string")), settings.seed, "key", "i")
    return training_loss(router, linspace_sample(ranked, settings.loss_pairs)), settings.loss_pairs


@dataclass(frozen=True)
class Probe:
    """Queries with their true neighbours, on which each cycle's tree is tried: the ``most`` first, a small set."""

    queries: DataFrame
    truth: DataFrame
    beam_size: int
    num_leaves: int
    top_k: int = 10
    most: int | None = None

    def tried(self) -> tuple[DataFrame, DataFrame]:
        if self.most is None:
            return self.queries, self.truth
        first = self.queries.orderBy("query_id").limit(self.most)
        return first, self.truth.join(first.select("query_id"), "query_id", "left_semi")


def probe_cycle(probe: Probe, router: SharedRouter, paths: DataFrame, vectors: DataFrame, settings: TrainSettings, tree_id: int) -> dict:
    """Recall and mean candidates of one tree with a router, and the number of queries."""
    queries, truth = probe.tried()
    weights = router.table(vectors.sparkSession, tree_id)
    beam = materialise(search.beam_search(queries, weights, settings.k, settings.h, probe.beam_size, probe.num_leaves), "beam")
    cells = search.vector_cells(paths)
    ranked = search.rerank_probed(beam, search.by_cell(vectors, cells), queries, 1, 1, probe.top_k, settings.metric)
    recall, n = metrics.recall_per_query(ranked, truth, probe.top_k).agg(F.avg("recall"), F.count("*")).first()
    mean = search.probed_counts(beam, cells, queries, 1).agg(F.avg("n_candidates")).first()[0]
    return {"recall": recall, "mean_candidates": mean, "queries": n}


def reassign(router: SharedRouter, vectors: DataFrame, settings: TrainSettings, n: int, tree_id: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """New (tree_id, vec_id, path, leaf_id) of all vectors, level by level, and each level's assignment."""
    now = vectors.select("vec_id", "embedding", F.lit(tree_id).alias("tree_id"), F.expr("cast(array() as array<int>)").alias("prefix"))
    levels, weights = [], router.table(vectors.sparkSession, tree_id)
    assign = assign_round if settings.mode == "round" else assign_sequential
    for depth in range(settings.h):
        scored = node_probs(now, weights)
        placed = materialise(assign(scored, settings.k, capacity(n, settings.k, depth, settings.alpha), settings.order), "assigned")
        levels.append(placed)
        now = next_level(placed).join(vectors.select("vec_id", "embedding"), "vec_id")
    return now.select("tree_id", "vec_id", F.col("prefix").alias("path"), path_to_leaf(F.col("prefix"), settings.k).alias("leaf_id")), levels


def improvement(best: float | None, now: float) -> float | None:
    """Relative fall of the loss; None if there is none to compare with."""
    return None if not best else (best - now) / abs(best)


#: What is told of a stage of a cycle; called as soon as the stage is done.
Sink = Callable[[dict], None]


def alternating_train(
    vectors: DataFrame, settings: TrainSettings, tree_id: int = 0, probe: Probe | None = None, sink: Sink | None = None
) -> tuple[SharedRouter, DataFrame, list[dict]]:
    """(router, tree_paths, a row of diagnostics a cycle). ``vectors``: (vec_id, embedding).

    ``sink`` gets a row after each fit (stage ``router``: the new router on the tree as it was) and after each
    reassignment (stage ``tree``), so what is done of a run that breaks off is known."""
    n = vectors.count()
    seed = settings.seed + tree_id
    queries = sample_ids(vectors, max(1, int(n * settings.query_fraction)), seed).select(F.col("vec_id").alias("query_id"), "embedding")
    queries = materialise(queries, "queries")
    paths = materialise(random_init(vectors, settings.k, settings.h, seed, tree_id), "paths")
    best, stale, rows, router, neighbours = None, 0, [], None, None
    cycle = 0

    def tell(stage: str, began: float, loss: float, pairs: int, **more) -> dict:
        tried = probe_cycle(probe, router, paths, vectors, settings, tree_id) if probe else {}
        if sink:
            gini = metrics.leaf_size_stats(paths, settings.k, settings.h).first()["gini"]
            sink({"tree": tree_id, "cycle": cycle, "stage": stage, "loss": loss, "loss_pairs": pairs, "leaf_gini": gini, "seconds": time.perf_counter() - began} | tried | more)
        return tried

    while settings.max_cycles < 1 or cycle < settings.max_cycles:
        began = time.perf_counter()
        sampled = settings.subset_size is not None and settings.subset_size < n  # of all vectors, neighbours stay the same
        if neighbours is None or (sampled and settings.label_refresh == "per_cycle"):
            label_seed = seed + 1 if settings.label_refresh == "once" else seed + cycle
            neighbours = materialise(mine_labels(queries, vectors, settings.top_k, settings.subset_size, label_seed, settings.metric), "labels")
        pairs = materialise(training_pairs(queries, neighbours, paths, settings.k), "pairs")
        router = fit_router(pairs, settings, router)
        loss, measured = sampled_loss(router, pairs, settings)
        if not math.isfinite(loss):
            raise ValueError(f"cycle {cycle}: the loss is {loss}")
        if sink:
            tell("router", began, loss, measured)
        began = time.perf_counter()
        new, levels = reassign(router, vectors, settings, n, tree_id)
        paths = materialise(new, "paths")
        report = {"mode": settings.mode, "order": settings.order, "levels": [level_report(x) for x in levels]}
        after = loss
        if sink:  # the same pairs under the new tree's labels
            after, measured = sampled_loss(router, training_pairs(queries, neighbours, paths, settings.k), settings)
        rows.append({"cycle": cycle, "loss": loss} | report | tell("tree", began, after, measured, **report))
        gain = improvement(best, loss)
        stale = 0 if gain is None or gain >= settings.min_delta else stale + 1
        best = loss if best is None else min(best, loss)
        cycle += 1
        if settings.patience is not None and stale >= settings.patience:
            break
    return router, paths, rows
