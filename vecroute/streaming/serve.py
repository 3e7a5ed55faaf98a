"""Queries as a stream, answered from a fixed index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecroute.operators.search import search_results


def serve(
    queries: DataFrame, router: DataFrame, tree_paths: DataFrame, vectors: DataFrame, output: str, checkpoint: str,
    k: int, h: int, n_trees: int, beam_size: int, top_k: int = 10, num_leaves: int | None = None, min_trees: int | None = None,
) -> StreamingQuery:
    """Write (query_id, rank, vec_id, distance) of each micro-batch below ``output``.

    A batch goes to a folder of its own number, which is overwritten if the batch is run again: a
    restart neither loses nor repeats results. The index is static, so no state and no watermark.
    """

    def answer(batch: DataFrame, number: int) -> None:
        found = search_results(batch, router, tree_paths, vectors, k, h, n_trees, beam_size, top_k, num_leaves, min_trees)
        found.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
