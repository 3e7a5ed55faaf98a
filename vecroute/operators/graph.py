"""Graph baseline: a neighbour graph made by rounds of joins, and walks over it with a join a hop.

Building is neighbour descent: whoever is near a vector's neighbours is likely near the vector. In a round,
each vector's list of neighbours and of those that name it is brought together with their embeddings, all
pairs of the list are measured by a matrix product, and each end of a pair keeps the other if it is nearer
than the worst it has. Only pairs with a link that is new since the round before are tried, so rounds get
cheaper; they end when few links change, or after a fixed number.

A list is what a round compares with itself. It holds a vector's own ``degree`` links and at most ``degree``
of those that point to it, by a hash that changes from round to round, so one that very many name
costs no more than others; what is passed over has other rounds and other middle points to be found by.

A walk keeps each query's nearest vectors so far; a hop joins those not yet opened with the graph, measures
their links that the query hasn't met, and keeps the best again. It ends when no query has an unopened one
among its best, or after a fixed number of hops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.distance import DENSE, matrix_of
from vecroute.functions.paths import shuffled_rank
from vecroute.functions.storage import materialise
from vecroute.operators.knn import pair_distances, sample_ids
from vecroute.operators.search import distances

LINK = "vec_id long, near_id long, distance double"


def first_links(vectors: DataFrame, degree: int, seed: int) -> DataFrame:
    """(vec_id, near_id) of ``degree`` others each: those that follow in a shuffled ring."""
    ring = shuffled_rank(vectors.select("vec_id"), seed).select("vec_id", "rank")
    n = ring.count()
    steps = F.explode(F.sequence(F.lit(1), F.lit(min(degree, n - 1)))) if n > 1 else F.explode(F.array().cast("array<int>"))
    asked = ring.select("vec_id", "rank", steps.alias("step")).select("vec_id", F.pmod(F.col("rank") + F.col("step"), F.lit(n)).alias("place"))
    return asked.join(ring.select(F.col("vec_id").alias("near_id"), F.col("rank").alias("place")), "place").select("vec_id", "near_id")


#: Lists whose pairs are handed on together: at most 2,401 a list of 49.
LISTS = 64


def _joined(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["vec_id", "near_id", "distance"])


def _tried(metric: str):
    """Of each list of vectors, the pairs that a link of its ends may be replaced by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = b.column(0)
            parts: list[tuple] = []
            for i in range(b.num_rows):
                if len(parts) >= 2 * LISTS:  # a batch's pairs are many times the batch
                    yield _joined(parts)
                    parts = []
                s = links[i].values
                ids, fresh = s.field("id").to_numpy(), s.field("fresh").to_numpy(zero_copy_only=False)
                m, worst = matrix_of(s.field("embedding")), s.field("worst").to_numpy()
                one, two = np.nonzero(np.triu(fresh[:, None] | fresh[None, :], 1))
                d = np.round(pair_distances(m[one], m[two], metric), 9)
                for x, y in ((one, two), (two, one)):
                    better = (d < worst[x]) & (ids[x] != ids[y])
                    parts.append((ids[x[better]], ids[y[better]], d[better]))
            if parts:
                yield _joined(parts)

    return run


def _best(links: DataFrame, degree: int) -> DataFrame:
    """Each vector's nearest ``degree``, a link once; old ones before new of the same."""
    once = links.groupBy("vec_id", "near_id").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "near_id"))
    return once.withColumn("place", (place - 1).cast("int")).where(F.col("place") < degree)


def build_graph(vectors: DataFrame, degree: int = 16, rounds: int = 8, metric: str = "euclidean", seed: int = 0, stop: float = 0.001) -> DataFrame:
    """(vec_id, near_id, distance, place): each vector's ``degree`` nearest that ``rounds`` of descent find.

    ``vectors``: (vec_id, embedding). Ends early when a round changes less than ``stop`` of the links."""
    if metric not in DENSE:
        raise ValueError(f"{metric!r} can't be mined; one of {', '.join(DENSE)}")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    start = first_links(rows, degree, seed).withColumnsRenamed({"vec_id": "query_id", "near_id": "vec_id"})
    measured = distances(start, rows.withColumnRenamed("vec_id", "query_id"), rows, metric)
    links = measured.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("near_id"), "distance", F.lit(True).alias("fresh"))
    now = materialise(_best(links, degree), "graph")
    total = now.count()
    for turn in range(rounds):
        worst = now.groupBy("vec_id").agg(F.max("distance").alias("worst"), F.count("*").alias("n"))
        ends = rows.join(worst, "vec_id").select(
            F.col("vec_id").alias("id"), "embedding", F.when(F.col("n") >= degree, F.col("worst")).otherwise(float("inf")).alias("worst")
        )
        back = now.select(F.col("near_id").alias("mid"), F.col("vec_id").alias("id"), "fresh")
        pick = F.row_number().over(Window.partitionBy("mid").orderBy(F.desc("fresh"), F.xxhash64("mid", "id", F.lit(seed + turn)), "id"))
        back = back.withColumn("r", pick).where(F.col("r") <= degree).drop("r")
        both = now.select(F.col("vec_id").alias("mid"), F.col("near_id").alias("id"), "fresh").unionByName(back)
        own = now.select("vec_id").distinct().select(F.col("vec_id").alias("mid"), F.col("vec_id").alias("id"), F.lit(False).alias("fresh"))
        both = both.unionByName(own).groupBy("mid", "id").agg(F.max("fresh").alias("fresh"))
        lists = both.join(ends, "id").groupBy("mid").agg(F.collect_list(F.struct("id", "fresh", "worst", "embedding")).alias("list"))
        tried = lists.where(F.exists("list", lambda x: x["fresh"])).select("list").mapInArrow(_tried(metric), LINK)
        kept = now.withColumn("fresh", F.lit(False)).select("vec_id", "near_id", "distance", "fresh")
        now = materialise(_best(kept.unionByName(tried.withColumn("fresh", F.lit(True))), degree), "graph")
        if now.where("fresh").count() <= stop * total:
            break
    return now.select("vec_id", "near_id", "distance", "place")


def both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """(vec_id, near_id): links, and at most ``degree`` of those that point to a vector, the nearest ones."""
    back = graph.select(F.col("near_id").alias("vec_id"), F.col("vec_id").alias("near_id"), "distance")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "near_id"))
    back = back.withColumn("r", place).where(F.col("r") <= degree)
    return graph.select("vec_id", "near_id").unionByName(back.select("vec_id", "near_id")).distinct()


def search_graph(
    queries: DataFrame, vectors: DataFrame, graph: DataFrame, top_k: int = 10, width: int = 32, hops: int = 12, entries: int = 64, opened: int = 4,
    metric: str = "euclidean", seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(results, pairs measured): walks that begin at ``entries`` vectors and open ``opened`` of the ``width`` best a hop.

    ``graph``: (vec_id, near_id) as of ``both_ways``. Results are (query_id, rank, vec_id, distance)."""
    gates = sample_ids(vectors.select("vec_id"), entries, seed).select("vec_id")  # of a fixed number
    asked = queries.select("query_id", F.explode(F.array(*(F.lit(r["vec_id"]) for r in gates.collect()))).alias("vec_id"))
    met = materialise(distances(asked, queries, vectors, metric).withColumn("open", F.lit(False)), "walk")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    for _ in range(hops):
        held = met.withColumn("place", F.row_number().over(best))
        waits = (F.col("place") <= width) & ~F.col("open")
        turn = F.sum(waits.cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
        held = materialise(held.withColumn("now", waits & (turn <= opened)).drop("place"), "walk")
        going = held.where("now")
        if not going.limit(1).count():
            break
        reached = going.select("query_id", "vec_id").join(graph, "vec_id").select("query_id", F.col("near_id").alias("vec_id")).distinct()
        new = reached.join(held.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
        found = distances(new, queries, vectors, metric).withColumn("open", F.lit(False))
        met = materialise(held.withColumn("open", F.col("open") | F.col("now")).drop("now").unionByName(found), "walk")
    place = (F.row_number().over(best) - 1).cast("int")
    results = met.withColumn("rank", place).where(F.col("rank") < top_k).select("query_id", "rank", "vec_id", "distance")
    return results, met.select("query_id", "vec_id")
