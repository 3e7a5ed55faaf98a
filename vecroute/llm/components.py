"""Connected components of links, distributed: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.llm.common import materialise


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): ``comp`` is the smallest node of its component.

    A round takes the least label among a node and its neighbours, then that label's own label, so long
    chains halve; each round is written, and the last changes nothing. All steps are joins and partial
    aggregates, so a node with very many links doesn't gather in one task.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = materialise(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = materialise(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")),
        "labels",
    )
    for _ in range(most_rounds):
        near = (
            edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        )
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "m").alias("next")
        )
        jump = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        moved = materialise(
            step.join(jump, step["next"] == jump["n2"], "left").select(
                "node", "old", F.coalesce("c2", "next").alias("comp")
            ),
            "labels",
        )
        labels = moved.select("node", "comp")
        if not moved.where("old <> comp").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
