"""Capacity-balanced assignment of vectors to the branches of tree nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.ranks import places
from vecroute.functions.storage import materialise

ORDERS = ("confidence", "margin", "input")
NODE = ["tree_id", "prefix"]


def capacity(n: int, k: int, level: int, alpha: float = 1.0) -> int:
    """Most vectors a branch of level ``level`` (from 0) may hold."""
    return max(1, int(np.ceil(alpha * n / k ** (level + 1))))


def branch_order(probs: Column) -> Column:
    """Branches by falling probability; ties by branch."""
    ranked = F.array_sort(F.transform(probs, lambda p, b: F.struct((-p).alias("m"), b.alias("b"))))
    return F.transform(ranked, lambda x: x["b"])


def margin(probs: Column) -> Column:
    """Best minus second-best probability."""
    ranked = F.sort_array(probs, asc=False)
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))


def visit_score(probs: Column, order: str) -> Column:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    return {"confidence": F.array_max(probs), "margin": margin(probs), "input": F.lit(0.0)}[order]


def _queue_step(order: str, t: int) -> Column:
    """The start of the order in which a branch's askers stand: who has less comes before all who have more."""
    if order != "input":
        return F.floor(-F.col("__s") * 4096).cast("long")
    return F.get("__ord", F.lit(t - 1)).cast("long") if t else F.shiftright("vec_id", 12).cast("long")


def _one_round(left: DataFrame, filled: DataFrame, t: int, cap: int, order: str) -> DataFrame:
    """``left`` with ``branch``: that of those who get a seat in round ``t``, null for the others.

    Askers are counted by steps of their queue; running sums over the steps tell who is in and who is out.
    Only the steps in which a branch's last free seat lies are sorted, by ranges: a step may hold any share of a
    node (scores that are all alike stand in one), and no task sees all of it.
    """
    seat = [*NODE, "__key", "__step"]
    asks = left.withColumn("__key", F.get("__ord", F.lit(t))).withColumn("__step", _queue_step(order, t))
    before = Window.partitionBy(*NODE, "__key").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        asks.groupBy(*seat)
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(filled, [*NODE, "__key"], "left")
        .withColumn("__free", F.greatest(F.lit(0), F.lit(cap) - F.coalesce("__taken", F.lit(0))))
    )
    judged = asks.join(steps, seat)
    inside = F.col("__before") + F.col("__n") <= F.col("__free")
    outside = F.col("__before") >= F.col("__free")
    tried = [F.get("__ord", F.lit(j)) for j in range(t - 1, -1, -1)]
    edge = places(judged.where(~inside & ~outside), seat, [F.desc("__s"), *tried, F.col("vec_id")], "__place", "edge")
    edge = edge.withColumn("__in", F.col("__before") + F.col("__place") <= F.col("__free")).drop("__place")
    clear = judged.where(inside | outside).withColumn("__in", inside)
    return clear.unionByName(edge).select(*left.columns, F.when(F.col("__in"), F.col("__key")).alias("branch"))


def _finish(columns: list[str], k: int, cap: int, t: int):
    """Rounds from ``t`` on for one node whose rows are few."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wanted, score = np.stack(rows["__ord"].to_numpy()), rows["__s"].to_numpy()
        taken = np.array(rows["__seats"].iloc[0], np.int64)
        queue = np.lexsort([rows["vec_id"].to_numpy(), *(wanted[:, j] for j in range(t)), -score])
        branch, rank = np.full(len(rows), -1), np.full(len(rows), k)
        for step in range(t, k):
            if not len(queue):
                break
            asked = wanted[queue, step]
            by = np.argsort(asked, kind="stable")
            queue, asked = queue[by], asked[by]
            takes = np.arange(len(queue)) - np.searchsorted(asked, asked) < (cap - taken)[asked]
            branch[queue[takes]], rank[queue[takes]] = asked[takes], step
            taken += np.bincount(asked[takes], minlength=k)
            queue = queue[~takes]
            queue = queue[np.argsort(-score[queue], kind="stable")]
        branch[queue] = int(np.argmin(taken))
        probs = np.stack(rows["probs"].to_numpy())[np.arange(len(rows)), branch]
        fell = rank == k
        return rows[columns].assign(branch=branch, chosen_rank=rank, used_fallback=fell, prob=pd.Series(np.where(fell, None, probs), rows.index, dtype=object))

    return run


def assign_round(scored: DataFrame, k: int, cap: int, order: str = "confidence", finish_rows: int = 32_768) -> DataFrame:
    """Round-based assignment of ``scored`` (tree_id, prefix, vec_id, probs) to branches.

    In round t every vector not yet placed tries its t-th branch, in which those already placed keep their
    seats and the rest follow by falling score, then by the branches they tried before, latest first, then by
    id, until the branch holds ``cap``. What is left after ``k`` rounds goes to the node's least full branch.

    A round handles all nodes of a level at once, reads only rows that are not placed, and is written before
    the next. As soon as at most ``finish_rows`` rows of a node are left, one task does its other rounds.

    Adds branch, chosen_rank (``k`` for what was left), used_fallback and prob (null for those).
    """
    columns = scored.columns
    left = materialise(scored.withColumns({"__ord": branch_order(F.col("probs")), "__s": visit_score(F.col("probs"), order).cast("double")}), "unplaced")
    filled = left.select(*NODE, F.lit(0).alias("__key"), F.lit(0).cast("long").alias("__taken")).limit(0)
    out = left.limit(0).select(*columns, F.lit(0).alias("branch"), F.lit(0).alias("chosen_rank"), F.lit(False).alias("used_fallback"), F.lit(0.0).alias("prob"))
    schema = out.schema
    for f in schema:
        f.nullable = True
    parts = []
    for t in range(k + 1):
        sizes = left.groupBy(*NODE).agg(F.count("*").alias("__n"))
        few = F.col("__n") <= finish_rows
        small, large = sizes.agg(F.count_if(few), F.count_if(~few)).first()
        if small and t < k:
            seats = filled.groupBy(*NODE).agg(F.map_from_entries(F.collect_list(F.struct("__key", "__taken"))).alias("__m"))
            ready = left.join(sizes.where(few).select(*NODE), NODE, "left_semi") if large else left
            ready = ready.join(seats, NODE, "left").withColumn("__seats", F.expr(f"transform(sequence(0, {k - 1}), b -> coalesce(__m[b], 0L))")).drop("__m")
            parts.append(ready.groupBy(*NODE).applyInPandas(_finish(columns, k, cap, t), schema))
            left = left.join(sizes.where(~few).select(*NODE), NODE, "left_semi") if large else left.limit(0)
        if not large and (small == 0 or t < k):
            break
        if t == k:
            parts.append(_to_least_full(left, filled, k).select(*columns, "branch", F.lit(k).alias("chosen_rank"), F.lit(True).alias("used_fallback"), F.lit(None).cast("double").alias("prob")))
            break
        now = materialise(_one_round(left, filled, t, cap, order), "round")
        won = now.where("branch is not null")
        parts.append(won.select(*columns, "branch", F.lit(t).alias("chosen_rank"), F.lit(False).alias("used_fallback"), F.get("probs", F.col("branch")).alias("prob")))
        more = won.groupBy(*NODE, F.col("branch").alias("__key")).agg(F.count("*").alias("__taken"))
        filled = materialise(filled.union(more).groupBy(*NODE, "__key").agg(F.sum("__taken").alias("__taken")), "filled")
        left = now.where("branch is null").drop("branch")
    for part in parts:
        out = out.unionByName(part)
    return out


def _to_least_full(left: DataFrame, filled: DataFrame, k: int) -> DataFrame:
    """``left`` with the branch of its node that has the fewest rows."""
    every = left.select(*NODE).distinct().withColumn("__key", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    taken = F.coalesce("__taken", F.lit(0)).alias("n")
    least = every.join(filled, [*NODE, "__key"], "left").groupBy(*NODE).agg(F.min(F.struct(taken, "__key"))["__key"].alias("branch"))
    return left.join(least, NODE)


def assign_sequential(scored: DataFrame, k: int, cap: int, order: str = "confidence") -> DataFrame:
    """One vector at a time, each to its best branch with room, else the least full, without a serial task.

    A vector's branch follows from the places in the visit order at which its node's branches filled up. Each
    of ``k`` passes finds every node's next place: all vectors take their best branch not known to be full,
    and the branch that reaches ``cap`` first is full from there. Who is past all places meets only full
    branches, so those are dealt out in turn. The visit order is one range sort; the place of a branch's last
    vector is found by counts of blocks of 4,096 and then within one block.
    """
    rows = scored.withColumns({"__ord": branch_order(F.col("probs")), "__s": visit_score(F.col("probs"), order)})
    keys = ["tree_id", "prefix", F.desc("__s"), "vec_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = materialise(rows.drop("__s"), "visits")
    node, branch = ["tree_id", "prefix"], ["tree_id", "prefix", "__key"]
    block = F.shiftright("__at", 12).alias("__block")
    full = rows.select(*node).distinct().withColumn("__full", F.array_repeat(F.lit(None).cast("long"), k))
    full = materialise(full, "full")

    def taken(full: DataFrame) -> DataFrame:
        """``rows`` with the branch each takes, null where all are full."""
        return rows.join(full, node).withColumn("__key", F.expr("get(filter(__ord, b -> __full[b] is null or __at <= __full[b]), 0)"))

    for _ in range(k):
        asks = taken(full).where("__key is not null and __full[__key] is null").select(*branch, "__at", block)
        upto = F.sum("n").over(Window.partitionBy(*branch).orderBy("__block"))
        counts = asks.groupBy(*branch, "__block").agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n"))
        cut = counts.where((F.col("before") < cap) & (F.col("before") + F.col("n") >= cap)).select(*branch, "__block", "before")
        seat = F.row_number().over(Window.partitionBy(*branch).orderBy("__at"))
        last = asks.join(cut, [*branch, "__block"]).withColumn("__seat", seat + F.col("before")).where(F.col("__seat") == cap)
        first = last.groupBy(*node).agg(F.min(F.struct("__at", "__key")).alias("x"))
        grown = F.expr("transform(__full, (p, b) -> if(x is not null and b = x.__key, x.__at, p))")
        full = materialise(full.join(first, node, "left").select(*node, grown.alias("__full")), "full")
    now = taken(full)
    left = now.where("__key is null").select(*node, "__at", block)
    counts = left.groupBy(*node, "__block").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*node).orderBy("__block")) - F.col("n"))
    turn = F.col("before") + F.row_number().over(Window.partitionBy(*node, "__block").orderBy("__at")) - 1
    turns = left.join(counts, [*node, "__block"]).select("__at", F.pmod(turn, F.lit(k)).cast("int").alias("__turn"))
    out = now.join(turns, "__at", "left").withColumn("used_fallback", F.col("__key").isNull())
    rank = F.coalesce(F.expr("cast(array_position(__ord, __key) as int) - 1"), F.lit(k))
    out = out.withColumns({"branch": F.coalesce("__key", "__turn"), "chosen_rank": rank})
    prob = F.when(~F.col("used_fallback"), F.get("probs", F.col("branch")))
    return out.select(*scored.columns, "branch", "chosen_rank", "used_fallback", prob.alias("prob"))


def next_level(assigned: DataFrame) -> DataFrame:
    """(tree_id, vec_id, prefix) of the nodes one level down."""
    return assigned.select("tree_id", "vec_id", F.concat("prefix", F.array("branch")).alias("prefix"))


# Lower edges of the rank histogram.
EDGES = [0, 1, 2, 3, 4, 8, 16, 32, 64, 128, 256]


def histogram_label(rank: Column) -> Column:
    """rank_0 ... rank_3, rank_4_7, ..., rank_256_plus."""
    out = F.lit(f"rank_{EDGES[-1]}_plus")
    for low, high in reversed(list(zip(EDGES, EDGES[1:], strict=False))):
        out = F.when(rank < high, F.lit(f"rank_{low}" if high == low + 1 else f"rank_{low}_{high - 1}")).otherwise(out)
    return out


def rank_histogram(assigned: DataFrame) -> DataFrame:
    """Vectors by bucket of the rank they got, without those placed by fallback; all buckets appear."""
    spark = assigned.sparkSession
    ends = [*EDGES[1:], None]
    labels = [f"rank_{a}" if b == a + 1 else f"rank_{a}_{b - 1}" if b else f"rank_{a}_plus" for a, b in zip(EDGES, ends, strict=True)]
    buckets = spark.createDataFrame(pa.table({"edge": pa.array(EDGES, pa.int32()), "bucket": labels}))  # as Arrow, it needs no Python workers
    counted = assigned.where(~F.col("used_fallback")).groupBy(histogram_label(F.col("chosen_rank")).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counted, "bucket", "left").select("edge", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n_vectors"))


def min_top_r(histogram: DataFrame, cover: float = 0.999) -> DataFrame:
    """The least R such that ranks below R cover the share: the edge after the first bucket that does."""
    order = Window.orderBy("edge")  # eleven rows
    run = histogram.select(
        "edge",
        F.sum("n_vectors").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.coalesce(F.lead("edge").over(order), F.col("edge")).alias("next_edge"),
        F.sum("n_vectors").over(Window.partitionBy()).alias("total"),
    )
    hit = run.where((F.col("total") > 0) & (F.col("upto") >= cover * F.col("total")))
    return hit.agg(F.coalesce(F.min(F.struct("edge", "next_edge"))["next_edge"], F.lit(0)).alias("min_top_r"))


def level_diagnostics(assigned: DataFrame) -> DataFrame:
    """Counts and means of one level's assignment."""
    first = F.get(branch_order(F.col("probs")), F.lit(0))
    return assigned.agg(
        F.count("*").alias("num_vectors"),
        F.count_if("used_fallback").alias("fallback_count"),
        F.count_if((F.col("branch") != first)).alias("denied_top_count"),
        F.max(F.when(~F.col("used_fallback"), F.col("chosen_rank"))).alias("max_chosen_rank"),
        F.avg("chosen_rank").alias("mean_chosen_rank"),
        *(
            (F.count_if(x) / F.greatest(F.count("*"), F.lit(1))).alias(name)
            for name, x in (
                ("second_choice_fraction", ~F.col("used_fallback") & (F.col("chosen_rank") == 1)),
                ("third_or_later_choice_fraction", ~F.col("used_fallback") & (F.col("chosen_rank") >= 2)),
                ("denied_top_fraction", F.col("branch") != first),
                ("fallback_fraction", F.col("used_fallback")),
            )
        ),
        F.avg("prob").alias("mean_assigned_prob"),
        F.avg(F.array_max("probs")).alias("mean_confidence"),
        F.avg(margin(F.col("probs"))).alias("mean_margin"),
    )


def level_report(assigned: DataFrame) -> dict:
    """``level_diagnostics``, the rank histogram and the covering rank of one level as one row."""
    hist = rank_histogram(assigned)
    buckets = {f"rank_hist_{r['bucket'].removeprefix('rank_')}": r["n_vectors"] for r in hist.collect()}
    return {**buckets, "min_top_r_covering_999": min_top_r(hist).first()[0], **level_diagnostics(assigned).first().asDict()}
