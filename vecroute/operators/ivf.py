"""Inverted-file baseline: k-means lists, probed by the nearest centroids."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise
from vecroute.operators.knn import exact_knn
from vecroute.operators.search import by_cell, rerank_probed, vector_cells


def build_ivf(vectors: DataFrame, n_lists: int, seed: int = 0, max_iter: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lists: vec_id, list_id; centroids: list_id, centroid)."""
    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter).fit(rows)
    lists = model.transform(rows).select("vec_id", F.col("prediction").alias("list_id"))
    centroids = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")
    return lists, centroids


def search_ivf(queries: DataFrame, vectors: DataFrame, lists: DataFrame, centroids: DataFrame, n_probe: int, top_k: int, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(results, probed members). The nearest centroids of a query are found as its nearest vectors are."""
    lists_as_vectors = centroids.select(F.col("list_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    near = exact_knn(queries, lists_as_vectors, n_probe, "inner_product" if metric == "inner_product" else "euclidean")
    probes = near.select("query_id", F.col("vec_id").cast("int").alias("list_id"))
    members = probes.join(lists, "list_id").select("query_id", "vec_id")
    # lists are the leaves of one tree
    leaf = F.col("list_id").cast("long").alias("leaf_id")
    opened = materialise(probes.select("query_id", F.lit(0).alias("tree_id"), leaf), "probes")
    cells = vector_cells(lists.select(F.lit(0).alias("tree_id"), leaf, "vec_id"))
    return rerank_probed(opened, by_cell(vectors, cells), queries, 1, 1, top_k, metric), members
