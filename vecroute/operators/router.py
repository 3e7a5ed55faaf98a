"""Routers: what tells, for a vector and a node, how likely each branch is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.distance import dot, matrix_of
from vecroute.functions.storage import materialise
from vecroute.operators.shared_router import SharedTree, log_softmax_rows, shared_trees

ROUTER_SCHEMA = "tree_id int, prefix array<int>, branch int, weight array<double>, bias double"


def centroid_router(members: DataFrame, digits: int = 6) -> DataFrame:
    """A linear router whose logit is -|x - c|^2 + |x|^2 for the centroid c of each branch's members.

    ``members``: (tree_id, prefix, branch, embedding). Means are rounded so that they don't depend on
    the order of summation.
    """
    cells = members.select("tree_id", "prefix", "branch", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    means = cells.groupBy("tree_id", "prefix", "branch").agg(Summarizer.mean(F.col("x")).alias("m"))
    rows = means.select("tree_id", "prefix", "branch", F.transform(vector_to_array("m"), lambda x: F.round(x, digits)).alias("c"))
    return rows.select(
        "tree_id", "prefix", "branch", F.transform("c", lambda x: 2 * x).alias("weight"), (-dot(F.col("c"), F.col("c"))).alias("bias")
    )


def logits(nodes: DataFrame, router: DataFrame, digits: int = 6) -> DataFrame:
    """One row per row of ``nodes`` (tree_id, prefix, embedding, ...) and branch, with ``logit``.

    The router's size is that of the tree, not of the data; Spark broadcasts it where its measured size
    is under the session's bound, and shuffles it otherwise.
    """
    joined = nodes.join(router, ["tree_id", "prefix"])
    return joined.withColumn("logit", F.round(dot(F.col("embedding"), F.col("weight")) + F.col("bias"), digits)).drop("weight", "bias")


def log_softmax(scored: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Add ``log_prob``: normalised over the branches of each (by) group."""
    w = Window.partitionBy(*by)
    shifted = F.col("logit") - F.max("logit").over(w)
    return scored.withColumn("__z", shifted).withColumn(
        "log_prob", F.round(F.col("__z") - F.log(F.sum(F.exp("__z")).over(w)), digits)
    ).drop("__z")


@dataclass(frozen=True)
class Node:
    """The branches of one node: their numbers, weights and biases."""

    branches: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def log_probs(self, vectors: np.ndarray, digits: int = 6) -> np.ndarray:
        """(vectors x branches), rounded as ``logits`` and ``log_softmax`` are."""
        if vectors.shape[1] != self.weights.shape[1]:
            raise ValueError(f"vectors of width {vectors.shape[1]}, a router of width {self.weights.shape[1]}")
        return log_softmax_rows(vectors @ self.weights.T + self.biases, digits)


@dataclass(frozen=True)
class LinearTree:
    """One tree of a linear router: its nodes by their paths."""

    nodes: dict[tuple, Node]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return vectors

    def log_probs(self, encoded: np.ndarray, prefix: tuple, digits: int = 6) -> tuple[np.ndarray, np.ndarray] | None:
        """(branches, log-probabilities) of one node for all rows; None if there is no such node."""
        node = self.nodes.get(prefix)
        return None if node is None else (node.branches, node.log_probs(encoded, digits))


#: A router up to this size goes to the tasks with their code; larger ones are joined.
ROUTER_BYTES = 64 << 20


def router_nodes(router: DataFrame, most_bytes: int = ROUTER_BYTES) -> dict[tuple, Node] | None:
    """Nodes by (tree_id, *prefix); None if the router's measured size is over ``most_bytes``."""
    rows, width = router.agg(F.count("*"), F.coalesce(F.max(F.size("weight")), F.lit(0))).first()
    if rows * (width + 8) * 8 > most_bytes:
        return None
    t = router.select("tree_id", "prefix", "branch", "weight", "bias").toArrow()
    if not t.num_rows:
        return {}
    if len(t["weight"].combine_chunks().value_lengths().unique()) > 1:
        raise ValueError("the router's weights must all have one width")
    weights = t["weight"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, width)
    branch, bias = t["branch"].to_numpy(), t["bias"].to_numpy()
    members: dict[tuple, list[int]] = {}
    for i, (tree, prefix) in enumerate(zip(t["tree_id"].to_pylist(), t["prefix"].to_pylist(), strict=True)):
        members.setdefault((tree, *prefix), []).append(i)
    ordered = {key: np.array(sorted(rows, key=lambda i: branch[i])) for key, rows in members.items()}
    return {key: Node(branch[i], weights[i], bias[i]) for key, i in ordered.items()}


def router_trees(router: DataFrame, most_bytes: int = ROUTER_BYTES) -> list[dict[int, LinearTree | SharedTree]] | None:
    """The router's trees, in groups of at most ``most_bytes`` that go to the tasks; None if a linear router is larger.

    A shared router has a few MB a tree, whatever the tree's number of nodes."""
    if "unit" not in router.columns:
        nodes = router_nodes(router, most_bytes)
        if nodes is None:
            return None
        trees: dict[int, dict[tuple, Node]] = {}
        for (tree, *prefix), node in nodes.items():
            trees.setdefault(tree, {})[tuple(prefix)] = node
        return [{tree: LinearTree(x) for tree, x in sorted(trees.items())}]
    groups: list[dict] = []
    size = most_bytes + 1
    for tree, found in shared_trees(router).items():
        size += found.nbytes
        if size > most_bytes:
            groups.append({})
            size = found.nbytes
        groups[-1][tree] = found
    return groups or [{}]


def node_probs(nodes: DataFrame, router: DataFrame, digits: int = 6, router_bytes: int = ROUTER_BYTES) -> DataFrame:
    """(tree_id, prefix, vec_id, probs): softmax over the branches of each vector's node.

    Vectors are scored by matrix products an Arrow batch: those of a level by a shared router, of whatever
    size, and those of a node by a linear one if that is small enough."""
    rows = nodes.select("tree_id", "prefix", "vec_id", "embedding")
    router = materialise(router, "router")
    groups = router_trees(router, router_bytes)
    if groups is None:
        scored = log_softmax(logits(rows, router, digits), ["tree_id", "prefix", "vec_id"], digits)
        return scored.groupBy("tree_id", "prefix", "vec_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("branch", "log_prob"))), lambda s: F.round(F.exp(s["log_prob"]), digits)).alias("probs")
        )
    schema = rows.select("tree_id", "prefix", "vec_id", F.array(F.lit(0.0)).alias("probs")).schema
    out = None
    for trees in groups:
        part = rows.mapInArrow(_node_blocks(trees, digits), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _node_blocks(trees: dict[int, LinearTree | SharedTree], digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: dict[tuple, list[int]] = {}
            for i, (tree, prefix) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                # the rows of a shared tree are scored together if they stand at one level
                shared = isinstance(trees.get(tree), SharedTree)
                places.setdefault((tree, len(prefix)) if shared else (tree, tuple(prefix)), []).append(i)
            for (tree, node), rows in places.items():
                known = trees.get(tree)
                if known is None or (isinstance(known, LinearTree) and node not in known.nodes):
                    continue
                part = b.take(pa.array(rows))
                encoded = known.encode(matrix_of(part.column(3)))
                if isinstance(known, SharedTree):
                    prefixes = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), node)
                    p = np.round(np.exp(known.scores(encoded, prefixes, digits)), digits)
                else:
                    p = np.round(np.exp(known.log_probs(encoded, node, digits)[1]), digits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), lists], names=["tree_id", "prefix", "vec_id", "probs"])

    return run
