"""Vectors stored by the leaves of their trees, so that a search reads the probed leaves alone.

A store is Parquet, split by tree and by runs of leaves into folders, sorted by leaf within files of small row
groups. A read for some leaves is pruned twice: by folder, and by row group and page on the leaf. Each tree
has a copy of the vectors; a candidate's vector is read from the first tree in which its leaf is probed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise, write_text
from vecroute.operators.search import beam_search, check_min_trees, leaf_code, probed_candidates, probed_cells, rerank_probed, side_by_side

#: Folders of a tree at most.
PARTS = 256
#: So many probed leaves are listed in the filter of a read; more would be all leaves of most folders anyway.
LISTED = 10_000


def write_leaf_store(vectors: DataFrame, tree_paths: DataFrame, k: int, h: int, path: str, group_bytes: int = 4 << 20) -> None:
    """``vectors`` (vec_id, embedding) below ``path``, once for each tree of ``tree_paths``."""
    width = max(1, -(-(k**h) // PARTS))
    rows = tree_paths.select("tree_id", "leaf_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    rows = rows.withColumn("part", F.floor(F.col("leaf_id") / width).cast("int"))
    # by ranges of the leaf, so a folder is a few files whatever its size, and a hot leaf has several
    dealt = rows.repartitionByRange("tree_id", "leaf_id", "vec_id").sortWithinPartitions("tree_id", "part", "leaf_id", "vec_id")
    dealt.write.option("parquet.block.size", group_bytes).partitionBy("tree_id", "part").parquet(f"{path}/leaves")
    write_text(vectors.sparkSession, f"{path}/store.json", json.dumps({"k": k, "h": h, "width": width}))


def read_leaves(spark: SparkSession, path: str, probed: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, vec_id, embedding) of the leaves that ``probed`` (tree_id, leaf_id) holds.

    Folders of other leaves aren't listed in the scan; of up to ``LISTED`` leaves, neither are other row groups
    read. The driver sees a row a folder and tree, and at most ``LISTED`` leaves."""
    layout = json.loads("".join(r[0] for r in spark.read.text(f"{path}/store.json").collect()))
    wanted = materialise(probed.select("tree_id", "leaf_id").distinct(), "probed")
    folders: dict[int, list[int]] = {}
    for r in wanted.select("tree_id", F.floor(F.col("leaf_id") / layout["width"]).cast("int").alias("part")).distinct().collect():
        folders.setdefault(r["tree_id"], []).append(r["part"])
    rows = spark.read.parquet(f"{path}/leaves").select("tree_id", "part", "leaf_id", "vec_id", "embedding")
    inside = F.lit(False)
    for tree, parts in folders.items():
        inside = inside | ((F.col("tree_id") == tree) & F.col("part").isin(parts))
    rows = rows.where(inside)
    if wanted.count() <= LISTED:
        leaves = [r["leaf_id"] for r in wanted.select("leaf_id").distinct().collect()]
        rows = rows.where(F.col("leaf_id").isin(leaves))
    return rows.drop("part").join(wanted, ["tree_id", "leaf_id"], "left_semi")


def search_store(
    queries: DataFrame, router: DataFrame, path: str, k: int, h: int, n_trees: int, beam_size: int, top_k: int = 10, num_leaves: int | None = None,
    min_trees: int | None = None, metric: str = "euclidean",
) -> tuple[DataFrame, DataFrame]:
    """(results, candidates) as of ``search.search``, from a store: vectors of leaves that no query probes aren't read."""
    results, probes, cells = store_results(queries, router, path, k, h, n_trees, beam_size, top_k, num_leaves, min_trees, metric)
    return results, probed_candidates(probes, cells, n_trees, min_trees).select("query_id", "vec_id")


def store_results(
    queries: DataFrame, router: DataFrame, path: str, k: int, h: int, n_trees: int, beam_size: int, top_k: int = 10, num_leaves: int | None = None,
    min_trees: int | None = None, metric: str = "euclidean",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The results of ``search_store``, and the probes and cells that tell the candidates."""
    spark, least = queries.sparkSession, check_min_trees(min_trees, n_trees)
    probes = materialise(beam_search(queries, router, k, h, beam_size, num_leaves), "probes")
    ids = read_leaves(spark, path, probes).select("tree_id", "leaf_id", "vec_id")  # embeddings aren't read here
    code, first = leaf_code(F.col("tree_id"), F.col("leaf_id")), F.min(F.struct("tree_id", "leaf_id")).alias("w")
    cells = materialise(ids.groupBy("vec_id").agg(F.sort_array(F.collect_list(code)).alias("cell"), first), "cells")
    held = probed_cells(probes, cells, n_trees, least).select("cell").distinct()
    found = materialise(cells.join(held, "cell", "left_semi").select("vec_id", "cell", "w.tree_id", "w.leaf_id"), "found")
    rows = found.join(read_leaves(spark, path, found), ["tree_id", "leaf_id", "vec_id"])
    results = rerank_probed(probes, side_by_side(rows), queries, n_trees, least, top_k, metric)
    return results, probes, cells.select("vec_id", "cell")
