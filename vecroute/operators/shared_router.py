"""A router with one hidden layer for all levels of a tree, which the path enters before it bends.

A node's branches are scored from sigmoid(W x + P[path so far] + L[level]) by one output layer, so the same
units cut along other directions in another node. ``pyspark.ml`` fits all levels together: each training pair
gives a row a level, with the true path so far, and the sum of their cross-entropies is what is minimised; a
later fit goes on from the weights of the one before.

What a vector gives to the hidden units is reckoned once for all nodes; a path adds a few columns. So a tree's
router has (width + height * branches) x units numbers whatever the number of its nodes, and goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vecroute.functions.distance import matrix_of

#: Unit -1 holds the biases of the output layer.
UNIT_SCHEMA = "tree_id int, height int, unit int, weight array<double>, bias double, out array<double>"


def log_softmax_rows(logit: np.ndarray, digits: int) -> np.ndarray:
    logit = np.round(logit, digits)
    z = logit - logit.max(axis=1, keepdims=True)
    return np.round(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), digits)


@dataclass(frozen=True)
class SharedTree:
    """The weights of one tree: into (units x inputs), bias (units), out (branches x units), out_bias (branches).

    Inputs are the vector, a one-hot branch for each level but the last, and a one-hot level."""

    k: int
    h: int
    into: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def width(self) -> int:
        return self.into.shape[1] - (self.h - 1) * self.k - self.h

    @property
    def nbytes(self) -> int:
        return self.into.nbytes + self.out.nbytes

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """What vectors give to the hidden units, whatever the path."""
        if vectors.shape[1] != self.width:
            raise ValueError(f"vectors of width {vectors.shape[1]}, a router of width {self.width}")
        return vectors @ self.into[:, : self.width].T + self.bias

    def scores(self, encoded: np.ndarray, prefixes: np.ndarray, digits: int = 6) -> np.ndarray:
        """Log-probabilities of the branches, (rows x branches); a prefix a row, or one for all."""
        depth = prefixes.shape[1]
        if depth >= self.h:
            raise ValueError(f"a path of {depth} branches has no node below it in a tree of height {self.h}")
        if prefixes.size and not (0 <= prefixes.min() and prefixes.max() < self.k):
            raise ValueError(f"no path of branches below {self.k}")
        given = self.into[:, self.into.shape[1] - self.h + depth][None, :]
        for d in range(depth):
            given = given + self.into[:, self.width + d * self.k + prefixes[:, d]].T
        return log_softmax_rows(0.5 * (1 + np.tanh((encoded + given) / 2)) @ self.out.T + self.out_bias, digits)

    def log_probs(self, encoded: np.ndarray, prefix: tuple, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(branches, log-probabilities) of one node for all rows."""
        return np.arange(self.k), self.scores(encoded, np.array([prefix], np.int64).reshape(1, -1), digits)

    def path_losses(self, vectors: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Of each vector, the cross-entropies of its path's levels, summed."""
        encoded, rows = self.encode(vectors), np.arange(len(vectors))
        return -sum(self.scores(encoded, paths[:, :d], 12)[rows, paths[:, d]] for d in range(self.h))


def shared_trees(router: DataFrame) -> dict[int, SharedTree]:
    """The trees of a table of units."""
    t = router.select("tree_id", "height", "unit", "weight", "bias", "out").toArrow().sort_by([("tree_id", "ascending"), ("unit", "ascending")])
    out = {}
    for tree in t["tree_id"].unique().to_pylist():
        rows = t.filter(pa.compute.equal(t["tree_id"], tree))
        last, units = rows.slice(0, 1), rows.slice(1)
        outer = matrix_of(units["out"].combine_chunks())
        out[tree] = SharedTree(
            outer.shape[1], last["height"][0].as_py(), matrix_of(units["weight"].combine_chunks()),
            units["bias"].to_numpy(), np.ascontiguousarray(outer.T), np.array(last["out"][0].as_py()),
        )
    return out


@dataclass
class SharedRouter:
    """A fitted tree router: weights as ``pyspark.ml`` has them, of inputs scaled by (mean, scale)."""

    k: int
    h: int
    layers: list[int]
    flat: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def tree(self) -> SharedTree:
        """The weights for vectors as they are: the scaling goes into them."""
        n_in, units, k = self.layers
        a, b, c = n_in * units, (n_in + 1) * units, (n_in + 1) * units + units * k
        into, bias = self.flat[:a].reshape(n_in, units).T.copy(), self.flat[a:b].copy()
        width = len(self.mean)
        into[:, :width] /= self.scale
        bias -= into[:, :width] @ self.mean
        return SharedTree(k, self.h, into, bias, np.ascontiguousarray(self.flat[b:c].reshape(units, k).T), self.flat[c:])

    def table(self, spark: SparkSession, tree_id: int = 0) -> DataFrame:
        """The router as rows of units, by ``UNIT_SCHEMA``: what is saved and searched with."""
        t = self.tree
        rows = [(tree_id, t.h, i, t.into[i].tolist(), float(t.bias[i]), t.out[:, i].tolist()) for i in range(len(t.bias))]
        rows.append((tree_id, t.h, -1, [], 0.0, t.out_bias.tolist()))
        schema = StructType.fromDDL(UNIT_SCHEMA)
        # as Arrow: a list of rows would start Python workers of another kind in every executor, which stay on
        return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema)), schema)


def fit_shared(pairs: DataFrame, k: int, h: int, hidden: int, max_iter: int, seed: int = 0, start: SharedRouter | None = None, block_rows: int = 128) -> SharedRouter:
    """``pairs`` (embedding, path): the network that tells each branch of the path from vector and path so far.

    Gradients are summed over blocks of ``block_rows`` rows, as matrix products."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    if start is None:
        of = Summarizer.metrics("mean", "std").summary(array_to_vector(x))
        found = pairs.select(of.alias("s")).select("s.mean", "s.std").first()
        mean, std = found["mean"].toArray(), found["std"].toArray()
        scale = np.where(std > 0, std, 1.0)
    else:
        mean, scale = start.mean, start.scale
    means, scales = (F.array(*(F.lit(float(v)) for v in a)) for a in (mean, scale))
    scaled = F.zip_with(F.zip_with(x, means, lambda a, b: a - b), scales, lambda a, b: a / b)

    def hot(wanted: F.Column, n: int) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == wanted, 1.0).otherwise(0.0))

    branch = [hot(F.when(F.col("depth") > d, F.get("path", F.lit(d))).otherwise(-1), k) for d in range(h - 1)]
    rows = pairs.select("path", scaled.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("depth"))
    rows = rows.select(array_to_vector(F.concat("x", *branch, hot(F.col("depth"), h))).alias("features"), F.get("path", F.col("depth")).cast("double").alias("label"))
    layers = [len(mean) + (h - 1) * k + h, hidden, k]
    net = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, tol=1e-5, blockSize=block_rows)
    if start is not None and start.layers == layers:
        net = net.setInitialWeights(Vectors.dense(start.flat))
    return SharedRouter(k, h, layers, net.fit(rows).weights.toArray(), mean, scale)


def pair_losses(router: SharedRouter, pairs: DataFrame) -> DataFrame:
    """(loss) of each pair (embedding, path): its levels' cross-entropies, summed."""
    tree = router.tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                loss = tree.path_losses(matrix_of(b.column(0)), matrix_of(b.column(1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(loss)], names=["loss"])

    return pairs.select("embedding", "path").mapInArrow(run, "loss double")
