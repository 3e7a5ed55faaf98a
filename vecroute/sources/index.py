"""An index as a folder: ``meta.json``, ``tree_paths/`` and ``router/`` in Parquet, no pickles."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.functions.paths import checked_path

VERSION = 2


@dataclass(frozen=True)
class IndexMeta:
    k: int
    h: int
    alpha: float
    n: int
    n_trees: int


def _meta(spark: SparkSession, path: str) -> IndexMeta:
    found = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta.json").collect()))
    if found.pop("version", None) != VERSION:
        raise ValueError(f"{path}: not an index of version {VERSION}")
    return IndexMeta(**found)


def save_index(tree_paths: DataFrame, router: DataFrame, meta: IndexMeta, path: str) -> None:
    """Paths are split by tree and root branch and sorted by leaf within files, so that probes of a few
    leaves skip files and row groups."""
    spark = tree_paths.sparkSession
    rows = tree_paths.withColumn("path", checked_path(F.col("path"), meta.k, meta.h)).withColumn("root", F.get("path", F.lit(0)))
    rows.repartition("tree_id", "root").sortWithinPartitions("tree_id", "root", "leaf_id", "vec_id").write.partitionBy("tree_id", "root").parquet(f"{path}/tree_paths")
    router.write.parquet(f"{path}/router")
    line = json.dumps({"version": VERSION, **asdict(meta)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/meta.json")


def load_index(spark: SparkSession, path: str, k: int | None = None, h: int | None = None, n: int | None = None, n_trees: int | None = None) -> tuple[DataFrame, DataFrame, IndexMeta]:
    """(tree_paths, router, meta), checked against what is expected; ``n_trees`` takes the first trees."""
    meta = _meta(spark, path)
    for name, wanted in (("k", k), ("h", h), ("n", n)):
        if wanted is not None and getattr(meta, name) != wanted:
            raise ValueError(f"{path}: {name} is {getattr(meta, name)}, not {wanted}")
    paths = spark.read.parquet(f"{path}/tree_paths").select("tree_id", "vec_id", "path", "leaf_id")
    router = spark.read.parquet(f"{path}/router")
    if n_trees is not None:
        if n_trees > meta.n_trees:
            raise ValueError(f"{path}: has {meta.n_trees} trees, not {n_trees}")
        paths, router = paths.where(F.col("tree_id") < n_trees), router.where(F.col("tree_id") < n_trees)
        meta = IndexMeta(meta.k, meta.h, meta.alpha, meta.n, n_trees)
    return paths, router, meta


def merge_trees(parts: list[DataFrame]) -> DataFrame:
    """Trees of several tables as one, numbered on by table and then by ``tree_id``, without gaps."""
    both = None
    for i, part in enumerate(parts):
        one = part.withColumn("__part", F.lit(i))
        both = one if both is None else both.unionByName(one)
    known = sorted(tuple(r) for r in both.select("__part", "tree_id").distinct().collect())  # a handful
    number = F.create_map(*(F.lit(x) for i, (part, tree) in enumerate(known) for x in (f"{part} {tree}", i)))
    return both.withColumn("tree_id", number[F.concat_ws(" ", "__part", "tree_id")]).drop("__part")


def merge_indexes(spark: SparkSession, inputs: list[str], output: str) -> IndexMeta:
    """One index with the trees of all, which must agree in k, h, alpha and n."""
    loaded = [load_index(spark, p) for p in inputs]
    shapes = {(m.k, m.h, m.alpha, m.n) for _, _, m in loaded}
    if len(shapes) != 1:
        raise ValueError(f"indexes differ: {sorted(shapes)}")
    k, h, alpha, n = shapes.pop()
    meta = IndexMeta(k, h, alpha, n, sum(m.n_trees for _, _, m in loaded))
    save_index(merge_trees([p for p, _, _ in loaded]), merge_trees([r for _, r, _ in loaded]), meta, output)
    return meta


def index_size_mb(spark: SparkSession, path: str) -> float:
    """Size of an index's files in MB, from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return (files.agg(F.sum("length")).first()[0] or 0) / 1e6
