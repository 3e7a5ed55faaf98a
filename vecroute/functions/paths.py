"""Leaf ids and paths of k-ary trees, and balanced first partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaf_to_path(leaf: Column, k: int, h: int) -> Column:
    """Digits of a leaf id in base ``k``, most significant first."""
    return F.array(*(F.pmod(F.floor(leaf / F.lit(k**d)), F.lit(k)).cast("int") for d in range(h - 1, -1, -1)))


def path_to_leaf(path: Column, k: int) -> Column:
    return F.aggregate(path, F.lit(0).cast("long"), lambda a, b: a * k + b)


def checked_path(path: Column, k: int, h: int | None = None) -> Column:
    """``path``, or an error where a branch lies outside 0..k-1 or the path hasn't ``h`` of them."""
    bad = F.exists(path, lambda b: b.isNull() | (b < 0) | (b >= k))
    if h is not None:
        bad = bad | (F.size(path) != h)
    what = F.concat(F.lit("no path of branches below "), F.lit(k), F.lit(": "), F.coalesce(path.cast("string"), F.lit("null")))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(what).cast("array<int>")).otherwise(path)


def shuffled_rank(vectors: DataFrame, seed: int, id_col: str = "vec_id", into: str = "rank") -> DataFrame:
    """``vectors`` with its place, from 0, in the order of a seeded hash of the id.

    Two levels, so that no task sees all rows: places within each of 4,096 ranges of the hash, and the
    ranges' running sums.
    """
    hashed = vectors.withColumn("__h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("__r", F.substring("__h", 1, 3))
    sizes = hashed.groupBy("__r").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__r").orderBy("__h", id_col))
    # at most 4,096 rows are broadcast
    return (
        hashed.withColumn("__place", place)
        .join(F.broadcast(base), "__r")
        .withColumn(into, (F.col("__base") + F.col("__place") - 1).cast("long"))
        .drop("__h", "__r", "__place", "__base")
    )


def random_init(vectors: DataFrame, k: int, h: int, seed: int = 0, tree_id: int = 0, id_col: str = "vec_id") -> DataFrame:
    """(tree_id, vec_id, path, leaf_id): shuffled ids dealt out in turn, so leaf sizes differ by one at most."""
    ranked = shuffled_rank(vectors.select(id_col), seed, id_col)
    leaf = F.pmod(F.col("rank"), F.lit(k**h)).cast("long")
    return ranked.select(
        F.lit(tree_id).alias("tree_id"), F.col(id_col).alias("vec_id"), leaf_to_path(leaf, k, h).alias("path"), leaf.alias("leaf_id")
    )
