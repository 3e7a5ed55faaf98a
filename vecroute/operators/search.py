"""Beam search over trees, leaf lookup, frequency filter and exact rerank, as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.distance import DENSE, matrix_of
from vecroute.functions.distance import metric as metric_of
from vecroute.functions.paths import path_to_leaf
from vecroute.functions.storage import materialise
from vecroute.operators.knn import nearest_in_blocks, pair_distances
from vecroute.operators.router import ROUTER_BYTES, LinearTree, log_softmax, logits, router_trees
from vecroute.operators.shared_router import SharedTree


def check_beam(beam_size: int, num_leaves: int | None) -> int:
    leaves = beam_size if num_leaves is None else num_leaves
    if leaves < 1 or leaves > beam_size:
        raise ValueError(f"num_leaves must lie in 1..{beam_size}, not {leaves}")
    return leaves


def check_min_trees(wanted: int | None, n_trees: int) -> int:
    """1 for a single tree, else 2, unless given."""
    m = wanted if wanted is not None else min(2, n_trees)
    if not 1 <= m <= n_trees:
        raise ValueError(f"min_trees must lie in 1..{n_trees}, not {m}")
    return m


def beam_paths(tree: LinearTree | SharedTree, vectors: np.ndarray, k: int, h: int, beam_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf numbers, scores) of the best paths of each vector in one tree, best first; -1 where there are fewer.

    A path is the number that its branches make in base ``k``, so equal scores go by number."""
    encoded = tree.encode(vectors)
    paths, scores = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
    for depth in range(h):
        grown, score = np.full((*paths.shape, k), -1, np.int64), np.full((*paths.shape, k), -np.inf)
        for number in np.unique(paths[paths >= 0]):
            q, w = np.nonzero(paths == number)
            found = tree.log_probs(encoded[q], tuple(int(number) // k**d % k for d in range(depth - 1, -1, -1)))
            if found is not None:
                cell = (q[:, None], w[:, None], found[0][None, :])
                grown[cell] = number * k + found[0]
                score[cell] = np.round(scores[q, w][:, None] + found[1], 6)
        paths, scores = grown.reshape(len(vectors), -1), score.reshape(len(vectors), -1)
        order = np.lexsort((paths, -scores), axis=1)[:, :beam_size]
        paths, scores = np.take_along_axis(paths, order, 1), np.take_along_axis(scores, order, 1)
    return paths, scores


def _beam_blocks(trees: dict[int, LinearTree | SharedTree], k: int, h: int, beam_size: int, leaves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, max(1, (1 << 22) // (k * beam_size))):
                part = b.slice(a, max(1, (1 << 22) // (k * beam_size)))
                vectors = matrix_of(part.column(1))
                for tree, weights in trees.items():
                    paths, scores = (x[:, :leaves] for x in beam_paths(weights, vectors, k, h, beam_size))
                    row, rank = np.nonzero(paths >= 0)
                    leaf = paths[row, rank]
                    digits = np.stack([leaf // k**d % k for d in range(h - 1, -1, -1)], axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(row)), pa.array(np.full(len(row), tree), pa.int32()), pa.array(rank, pa.int32()),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, digits.size + 1, h), pa.int32()), pa.array(digits.ravel())),
                            pa.array(leaf), pa.array(scores[row, rank]),
                        ],
                        names=["query_id", "tree_id", "leaf_rank", "path", "leaf_id", "score"],
                    )

    return run


def beam_search(
    queries: DataFrame, router: DataFrame, k: int, h: int, beam_size: int, num_leaves: int | None = None, router_bytes: int = ROUTER_BYTES
) -> DataFrame:
    """(query_id, tree_id, leaf_rank, path, leaf_id, score): the best leaves of every tree.

    ``queries``: (query_id, embedding). Leaves for fewer ``num_leaves`` are a prefix, by leaf_rank, of
    those for more, so a sweep filters one beam. A router of at most ``router_bytes`` goes to the tasks, which
    search all trees for an Arrow batch of queries, a matrix product a node; a larger one is joined level by level.
    """
    leaves = check_beam(beam_size, num_leaves)
    router = materialise(router, "router")
    groups = router_trees(router, router_bytes)
    if groups is not None:
        schema = "query_id long, tree_id int, leaf_rank int, path array<int>, leaf_id long, score double"
        out = None
        for group in groups:
            part = queries.select("query_id", "embedding").mapInArrow(_beam_blocks(group, k, h, min(beam_size, k**h), leaves), schema)
            out = part if out is None else out.unionByName(part)
        return out
    trees = sorted(r["tree_id"] for r in router.select("tree_id").distinct().collect())  # a handful
    roots = queries.select("query_id", "embedding", F.explode(F.array(*map(F.lit, trees))).alias("tree_id"))
    now = roots.select("query_id", "tree_id", "embedding", F.expr("cast(array() as array<int>)").alias("prefix"), F.lit(0.0).alias("score"))
    for _ in range(h):
        grown = log_softmax(logits(now, router), ["query_id", "tree_id", "prefix"])
        grown = grown.withColumn("score", F.round(F.col("score") + F.col("log_prob"), 6)).withColumn(
            "prefix", F.concat("prefix", F.array("branch"))
        )
        place = F.row_number().over(Window.partitionBy("query_id", "tree_id").orderBy(F.desc("score"), "prefix"))
        now = grown.withColumn("leaf_rank", (place - 1).cast("int")).where(F.col("leaf_rank") < min(beam_size, k**h))
        now = now.select("query_id", "tree_id", "embedding", "prefix", "score", "leaf_rank")
    return now.where(F.col("leaf_rank") < leaves).select(
        "query_id", "tree_id", "leaf_rank", F.col("prefix").alias("path"), path_to_leaf(F.col("prefix"), k).alias("leaf_id"), "score"
    )


#: A key's members meet the queries that want them in blocks of about this size both ways.
LOT = 2048
#: So many pairs a task makes of blocks, about.
TASK_PAIRS = 1 << 24
BLOCK = ["__no", "__lots", "__groups"]


def _in_lots(wanted: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (query_id, ...) joined to ``members`` (vec_id, ...) by ``keys``. Both are read twice.

    A key's members of one hash are a lot, its queries of one hash a group, and a lot and a group make a block. Blocks
    are dealt over tasks by the pairs that they make, which are counted, so more pairs are more tasks, not longer ones."""
    sizes, asking = members.groupBy(*keys).agg(F.count("*").alias("n")), wanted.groupBy(*keys).agg(F.count("*").alias("m"))
    dealt = sizes.join(asking, keys).withColumns({"lots": F.ceil(F.col("n") / LOT).cast("long"), "groups": F.ceil(F.col("m") / LOT).cast("long")})
    dealt = materialise(dealt.withColumn("__no", F.monotonically_increasing_id()), "lots")
    rows = F.col("n") * F.col("groups") + F.col("m") * F.col("lots")
    work = dealt.agg(F.sum(F.col("n") * F.col("m") + 16 * rows)).first()[0] or 0
    tasks = max(1, -(-work // TASK_PAIRS))

    def side(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Rows with the numbers of their key, lot and group: their own by a hash, and all of the other side's."""
        kept = [c for c in df.columns if c not in keys]
        here = df.join(dealt.select(*keys, "__no", F.col(own).alias("__own"), F.col(other).alias("__other")), keys)
        mine, every = F.pmod(F.xxhash64(name), F.col("__own")).alias(f"__{own}"), F.sequence(F.lit(0).cast("long"), F.col("__other") - 1)
        return here.select(*kept, "__no", mine, F.explode(every).alias(f"__{other}")).repartition(tasks, *BLOCK)

    return side(wanted, "query_id", "groups", "lots").hint("merge").join(side(members, "vec_id", "lots", "groups"), BLOCK).drop(*BLOCK)


def leaf_lookup(probes: DataFrame, tree_paths: DataFrame) -> DataFrame:
    """(query_id, tree_id, vec_id) of the members of probed leaves; an empty leaf has no rows."""
    members = materialise(tree_paths.select("tree_id", "leaf_id", "vec_id"), "members")
    wanted = materialise(probes.select("query_id", "tree_id", "leaf_id", F.col("tree_id").alias("of")), "wanted")
    return _in_lots(wanted, members, ["tree_id", "leaf_id"]).select("query_id", F.col("of").alias("tree_id"), "vec_id")


def leaf_code(tree: Column, leaf: Column) -> Column:
    """One number for a tree's leaf."""
    return F.shiftleft(tree.cast("long"), 44).bitwiseOR(leaf.cast("long"))


def vector_cells(tree_paths: DataFrame) -> DataFrame:
    """(vec_id, cell): the leaves that hold each vector, written. Vectors of one cell meet the same queries."""
    code = leaf_code(F.col("tree_id"), F.col("leaf_id"))
    return materialise(tree_paths.groupBy("vec_id").agg(F.sort_array(F.collect_list(code)).alias("cell")), "cells")


def probed_cells(probes: DataFrame, cells: DataFrame, n_trees: int, min_trees: int | None = None) -> DataFrame:
    """(query_id, cell, n_trees, n): cells whose ``n`` vectors are a query's candidates, as of ``select_candidates``.

    Its rows are those of queries and cells, not of queries and vectors."""
    least = check_min_trees(min_trees, n_trees)
    kinds = cells.groupBy("cell").agg(F.count("*").alias("n"))
    asked = probes.select("query_id", leaf_code(F.col("tree_id"), F.col("leaf_id")).alias("__code"))
    met = kinds.withColumn("__code", F.explode("cell")).join(asked, "__code")
    hit = met.groupBy("query_id", "cell").agg(F.count("*").cast("int").alias("n_trees"), F.first("n").alias("n"))
    if least == 1:
        return hit
    top = F.max("n_trees").over(Window.partitionBy("query_id"))
    return hit.withColumn("__top", top).where((F.col("n_trees") >= least) | (F.col("__top") < least)).drop("__top")


def probed_candidates(probes: DataFrame, cells: DataFrame, n_trees: int, min_trees: int | None = None) -> DataFrame:
    """``select_candidates`` of the members of the probed leaves, without a row a query, tree and vector."""
    wanted = materialise(probed_cells(probes, cells, n_trees, min_trees).select("query_id", "cell", "n_trees"), "wanted")
    return _in_lots(wanted, cells, ["cell"]).select("query_id", "vec_id", "n_trees")


def probed_counts(probes: DataFrame, cells: DataFrame, queries: DataFrame, n_trees: int, min_trees: int | None = None) -> DataFrame:
    """(query_id, n_candidates) of ``probed_candidates``, 0 for queries without any."""
    counts = probed_cells(probes, cells, n_trees, min_trees).groupBy("query_id").agg(F.sum("n").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def by_cell(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """``vectors`` with their cells, those of a cell side by side, written."""
    return side_by_side(cells.join(vectors.select("vec_id", "embedding"), "vec_id"))


def side_by_side(rows: DataFrame) -> DataFrame:
    """(vec_id, cell, embedding) by ranges of the cell, written."""
    return materialise(rows.select("vec_id", "cell", "embedding").repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"), "by-cell")


def rerank_probed(
    probes: DataFrame, celled: DataFrame, queries: DataFrame, n_trees: int, min_trees: int | None, top_k: int, metric: str = "euclidean"
) -> DataFrame:
    """``rerank`` of ``probed_candidates``, by matrix products of cells and the queries that probe them.

    ``celled``: vectors as of ``by_cell``. No pair is a row, or leaves its task, but for a task's best."""
    least = check_min_trees(min_trees, n_trees)
    if metric not in DENSE:
        cells = celled.select("vec_id", "cell")
        return rerank(probed_candidates(probes, cells, n_trees, least), queries, celled, top_k, metric)
    open_ = probes.groupBy("query_id").agg(F.collect_list(leaf_code(F.col("tree_id"), F.col("leaf_id"))).alias("probed"))
    asked = materialise(queries.select("query_id", "embedding").join(open_, "query_id"), "asked")
    return nearest_in_blocks(asked, celled, top_k, metric, least).withColumn("distance", F.round("distance", 9))


def select_candidates(members: DataFrame, n_trees: int, min_trees: int | None = None) -> DataFrame:
    """(query_id, vec_id, n_trees): ids in at least ``min_trees`` trees, or a query's whole union if none is."""
    least = check_min_trees(min_trees, n_trees)
    counted = members.groupBy("query_id", "vec_id").agg(F.count("*").cast("int").alias("n_trees"))
    if least == 1:
        return counted
    top = F.max("n_trees").over(Window.partitionBy("query_id"))
    return counted.withColumn("__top", top).where((F.col("n_trees") >= least) | (F.col("__top") < least)).drop("__top")


def sweep_candidates(probes: DataFrame, tree_paths: DataFrame, leaves: list[int], n_trees: int, min_trees: int | None = None) -> DataFrame:
    """(query_id, vec_id, budgets): of the numbers of leaves, those with which the vector is a candidate.

    A tree holds a vector from the place of its leaf in the beam on, so its places in the trees, ascending,
    tell the budgets at which it is in one tree, in two, and so on. A query takes vectors of any tree up to
    the budget at which some vector is in ``min_trees``."""
    least = check_min_trees(min_trees, n_trees)
    held = probes.where(F.col("leaf_rank") < max(leaves)).join(tree_paths.select("tree_id", "leaf_id", "vec_id"), ["tree_id", "leaf_id"])
    places = held.groupBy("query_id", "vec_id").agg(F.sort_array(F.collect_list("leaf_rank")).alias("places"))
    enters, any_tree = F.get("places", F.lit(least - 1)), F.get("places", F.lit(0))
    if least > 1:
        first = F.min(enters).over(Window.partitionBy("query_id"))
        places = places.withColumn("__first", F.coalesce(first, F.lit(max(leaves))))
    else:
        places = places.withColumn("__first", F.lit(-1))
    budgets = F.array(*(F.lit(m) for m in sorted(set(leaves))))
    inside = F.filter(budgets, lambda m: F.when(m > F.col("__first"), F.coalesce(enters < m, F.lit(False))).otherwise(any_tree < m))
    return places.select("query_id", "vec_id", inside.alias("budgets")).where(F.size("budgets") > 0)


def _measure(metric: str, names: list[str]):
    """Distances of the pairs of vectors in each Arrow batch; the vectors stand last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, two = matrix_of(b.column(len(names))), matrix_of(b.column(len(names) + 1))
                if one.shape[1] != two.shape[1]:
                    raise ValueError(f"queries of width {two.shape[1]}, vectors of width {one.shape[1]}")
                found = pa.array(pair_distances(two, one, metric))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), found], names=[*names, "distance"])

    return run


def distances(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``candidates`` (query_id, vec_id, ...) with ``distance``.

    Pairs of dense vectors are measured by Arrow blocks, ids and bits by Spark expressions.
    """
    return pair_rows(candidates.join(vectors.select("vec_id", "embedding"), "vec_id"), queries, metric)


def pair_rows(pairs: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """``pairs`` (query_id, vec_id, ..., embedding of the vector) with ``distance`` in place of the embedding."""
    d = metric_of(metric)
    names = [c for c in pairs.columns if c != "embedding"]
    asked = queries.select("query_id", F.col("embedding").alias("__q"))
    full = pairs.join(asked, "query_id").select(*names, "embedding", "__q")
    if metric not in DENSE:
        return full.select(*names, F.round(d(F.col("embedding"), F.col("__q")), 9).alias("distance"))
    schema = pairs.select(*names, F.lit(0.0).alias("distance")).schema
    return full.mapInArrow(_measure(metric, names), schema).withColumn("distance", F.round("distance", 9))


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, top_k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, rank, vec_id, distance): exact distances; ties go to the lower id."""
    pairs = candidates.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    return rerank_rows(pairs, queries, top_k, metric)


def rerank_rows(pairs: DataFrame, queries: DataFrame, top_k: int, metric: str = "euclidean") -> DataFrame:
    """``rerank`` of candidates that come with their vectors: (query_id, vec_id, embedding)."""
    measured = pair_rows(pairs, queries, metric)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return measured.withColumn("rank", (place - 1).cast("int")).where(F.col("rank") < top_k).select("query_id", "rank", "vec_id", "distance")


def search(
    queries: DataFrame, router: DataFrame, tree_paths: DataFrame, vectors: DataFrame, k: int, h: int, n_trees: int,
    beam_size: int, top_k: int = 10, num_leaves: int | None = None, min_trees: int | None = None, metric: str = "euclidean",
) -> tuple[DataFrame, DataFrame]:
    """(results, candidates) of the whole query operator."""
    probes, cells = probed(queries, router, tree_paths, k, h, beam_size, num_leaves)
    results = rerank_probed(probes, by_cell(vectors, cells), queries, n_trees, min_trees, top_k, metric)
    return results, probed_candidates(probes, cells, n_trees, min_trees)


def search_results(
    queries: DataFrame, router: DataFrame, tree_paths: DataFrame, vectors: DataFrame, k: int, h: int, n_trees: int,
    beam_size: int, top_k: int = 10, num_leaves: int | None = None, min_trees: int | None = None, metric: str = "euclidean",
) -> DataFrame:
    """The results of ``search``, without what is written to list the candidates."""
    probes, cells = probed(queries, router, tree_paths, k, h, beam_size, num_leaves)
    return rerank_probed(probes, by_cell(vectors, cells), queries, n_trees, min_trees, top_k, metric)


def probed(
    queries: DataFrame, router: DataFrame, tree_paths: DataFrame, k: int, h: int, beam_size: int, num_leaves: int | None
) -> tuple[DataFrame, DataFrame]:
    """The queries' leaves and the vectors' cells, written."""
    return materialise(beam_search(queries, router, k, h, beam_size, num_leaves), "beam"), vector_cells(tree_paths)


def to_wide(results: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, ids): arrays of ``top_k`` ids by rank, padded with -1; queries without results too."""
    lists = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("ids"))
    pad = F.array_repeat(F.lit(-1).cast("long"), top_k)
    return queries.select("query_id").join(lists, "query_id", "left").select(
        "query_id", F.slice(F.concat(F.coalesce("ids", F.expr("cast(array() as array<bigint>)")), pad), 1, top_k).alias("ids")
    )
