"""Merkle manifest of a table: digests of rows, trees by group, a root over all, and proofs by look-up.

Rows are leaves. A group's leaves, in order, are hashed by runs of ``fan`` until one node is left, the
group's subroot; the subroots, in the order of the groups, make a tree of the same kind, whose last node is
the root. Every node has a coordinate: (tree, level, place), where ``tree`` is the group's number, and
``TOP`` for the tree of the subroots. The nodes are a table, written level by level.

A proof is the digests beside the path from a leaf to the root. Which these are follows from the leaf's place
and the sizes of its group and of the top tree alone. Leaves of one run share all of it but their run, so a
run asks once for its leaves, and siblings are a run of nodes with one coordinate: a row for each run and
level, whatever ``fan``. The coordinates join the table of nodes, which has a row a run, too, and come back
in order, as what stands before and after the path at each level; concatenated they are the proof, folded
from a leaf they give the root.

Nodes near a root are asked for by nearly all runs. A run of nodes that has more than 1/``HOT`` of all lowest
runs below it is hot; a level can have at most ``HOT`` of these, whatever the input, so they are broadcast.
All others are joined by their coordinate, and no coordinate has more than 1/``HOT`` of the asks. What is
asked is written with a mark for hot ones, so that it is made once for both joins.

Places are given by one sort by ranges of (group, order): a group that holds a third of all rows is spread
over many ranges, and only the ranges' counts are summed up by group.

Defined cases: a null group is a group of its own, before the others; null values have a digest of their own
("-"); a lone leaf is its own subroot, a lone subroot the root, and the proof of a lone leaf in a lone group
is the digest of nothing; rows that tie go by their digests, so those that repeat are leaves of their own
with proofs of their own; an empty table gives no rows; columns named like the ones made here are an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecroute.llm.common import materialise

#: Number of the tree over the subroots.
TOP = -1
#: Nodes that more than one of so many runs asks for are broadcast.
HOT = 4096


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(parts.cast("binary"), 256)


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of values, each as the number of its UTF-8 bytes, a colon, and itself; ``-`` for null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in each group, ``size`` of the group, and ``tree``, the group's number from 0.

    One sort by ranges; a range's rows of a group stand together, so their places follow from the least
    number among them and the counts of the ranges before."""
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__no", F.monotonically_increasing_id())
    made = materialise(made.withColumn("__range", F.shiftright("__no", 33).cast("int")), name)
    counts = materialise(made.groupBy(group, "__range").agg(F.min("__no").alias("__first"), F.count("*").alias("__n")), f"{name}-ranges")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbers(counts.groupBy(group).agg(F.sum("__n").alias("size")), group, name).withColumnRenamed(group, "__h")
    spans = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(sizes, F.col(group).eqNullSafe(F.col("__h")))
    spans = spans.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), "__first", "__base", "size", "tree")
    spans = materialise(spans, f"{name}-spans")  # a row for each group and range: Spark broadcasts it where that is small
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r"))
    here = made.join(spans, same).withColumn("place", F.col("__no") - F.col("__first") + F.col("__base"))
    return here.drop("__no", "__range", "__g", "__r", "__first", "__base")


def numbers(groups: DataFrame, group: str, name: str) -> DataFrame:
    """``groups``, a row each, with ``tree``: their numbers in order, nulls first."""
    key = F.col(group).asc_nulls_first()
    made = groups.repartitionByRange(key).sortWithinPartitions(key).withColumn("__no", F.monotonically_increasing_id())
    made = materialise(made.withColumn("__range", F.shiftright("__no", 33).cast("int")), f"{name}-groups")
    counts = made.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return made.join(spans, "__range").withColumn("tree", F.col("__base") + F.col("__no").bitwiseAND(F.lit((1 << 33) - 1))).drop("__no", "__range", "__base")


def levels_of(size: Column, fan: int) -> Column:
    """Levels of a tree below its last node: 0 for a lone leaf."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0), lambda n, i: n + (size > F.pow(F.lit(float(fan)), i)).cast("int"))


@dataclass
class Tree:
    """The nodes of all trees by runs, (tree, level, run, digests, asked), and the last node of each, (tree, digest, below)."""

    nodes: DataFrame | None
    last: DataFrame


def build(leaves: DataFrame, most: int, fan: int, name: str, level: int = 0) -> Tree:
    """Trees of ``leaves`` (tree, place, size, digest, below), which stand at ``level``, the largest of ``most``.

    ``below`` is the number of lowest runs under a node, ``asked`` that under a run of nodes. Each level is
    written, a 1/fan of the one before."""
    nodes, last, now = None, None, leaves
    while True:
        done = now.where("size = 1").select("tree", "digest", "below")
        last = done if last is None else last.unionByName(done)
        if most <= 1:
            return Tree(nodes, last)
        more, most = now.where("size > 1"), -(-most // fan)
        children = F.sort_array(F.collect_list(F.struct("place", "digest")))
        runs = more.groupBy("tree", F.floor(F.col("place") / fan).alias("run"), "size").agg(F.sum("below").alias("below"), children.alias("children"))
        runs = materialise(runs, f"{name}-level")
        made = runs.select("tree", F.lit(level).alias("level"), "run", F.col("children.digest").alias("digests"), F.col("below").alias("asked"))
        nodes = made if nodes is None else nodes.unionByName(made)
        now = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / fan).alias("size"), digest(joined("children")).alias("digest"), "below")
        level += 1


def joined(children: str) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def path_steps(place: Column, size: Column, tree: Column, top: bool, first_level: int, fan: int) -> Column:
    """The steps up from a node at ``first_level``: (top, level, tree, run of the path's node, its place in the run)."""
    levels, wide_of = levels_of(size, fan), F.lit(float(fan))

    def step(level: Column) -> Column:
        at = F.floor(place / F.pow(wide_of, level - first_level)).cast("long")
        run = F.floor(at / fan).cast("long")
        return F.struct(F.lit(top).alias("top"), level.alias("level"), tree.cast("long").alias("tree"), run.alias("run"), (at - run * fan).cast("int").alias("at"))

    return F.transform(F.filter(F.sequence(F.lit(first_level), F.greatest(levels, F.lit(first_level))), lambda x: x < levels), step)


FOUND = "array<struct<top:boolean,level:int,digests:array<string>>>"


def looked_up(runs: DataFrame, nodes: DataFrame, n_runs: int, name: str) -> DataFrame:
    """(tree, run, found) for ``runs`` (tree, run, steps): the digests of the path's run at each step, with top and level."""
    key = ["tree", "level", "run"]
    hot = F.col("asked") * HOT > F.lit(n_runs)
    asked = runs.select(F.col("tree").alias("__t"), F.col("run").alias("__run"), F.explode("steps").alias("s"))
    asked = asked.select("__t", "__run", "s.top", *(f"s.{c}" for c in key))
    asked = asked.join(F.broadcast(nodes.where(hot).select(*key, F.lit(True).alias("hot"))), key, "left")
    asked = materialise(asked.withColumn("hot", F.coalesce("hot", F.lit(False))), f"{name}-asked")
    near = asked.where("hot").join(F.broadcast(nodes.where(hot).select(*key, "digests")), key)
    far = asked.where("not hot").join(nodes.where(~hot).select(*key, "digests"), key)
    found = F.sort_array(F.collect_list(F.struct("top", "level", "digests")))
    return near.unionByName(far).groupBy("__t", "__run").agg(found.alias("found"))


def manifest(rows: DataFrame, group: str, order: Sequence[str], fan: int = 16, name: str = "merkle") -> DataFrame:
    """``rows``, which have a ``leaf`` digest, with ``subroot``, ``root`` and ``path``: at each level the digests
    before and after the path, as one string each. Further columns stay beside their leaf."""
    if clash := sorted({"tree", "place", "size", "subroot", "root", "path"} & set(rows.columns)):
        raise ValueError(f"columns {clash} are there already")
    extra = [c for c in rows.columns if c != "leaf"]
    rows = materialise(rows, f"{name}-leaves")  # digests alone from here on: texts are read once
    child = F.struct("place", F.col("leaf").alias("digest"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)))
    run = placed(rows, group, [*order, "leaf"], name).groupBy("tree", F.floor(F.col("place") / fan).alias("run"), "size")
    base = materialise(run.agg(F.sort_array(F.collect_list(child)).alias("children")), f"{name}-runs")
    n_runs, most = base.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    up = base.select(
        "tree", F.col("run").alias("place"), F.ceil(F.col("size") / fan).alias("size"),
        F.when(F.col("size") == 1, F.col("children")[0]["digest"]).otherwise(digest(joined("children"))).alias("digest"), F.lit(1).cast("long").alias("below"),
    )
    inside = build(up, -(-most // fan), fan, name, 1)
    subroots = materialise(inside.last, f"{name}-subroots")
    n_trees = subroots.count()
    over = build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("size"), "digest", "below"), n_trees, fan, name)
    root = over.last.select("digest").first()  # one row, or none without leaves
    root = F.lit(root[0] if root else None).cast("string")

    ours = path_steps(F.col("run"), F.col("size"), F.col("tree"), False, 1, fan)
    theirs = path_steps(F.col("tree"), F.lit(n_trees).cast("long"), F.lit(TOP), True, 0, fan)
    runs = base.withColumn("steps", F.concat(ours, theirs))
    parts = [t.nodes for t in (inside, over) if t.nodes is not None]
    if parts:
        found = looked_up(runs.select("tree", "run", "steps"), parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], n_runs, name)
        runs = runs.join(found, (F.col("tree") == F.col("__t")) & (F.col("run") == F.col("__run")), "left").drop("__t", "__run")
    else:
        runs = runs.withColumn("found", F.array().cast(FOUND))

    def run_of(step: Column) -> Column:
        return F.get(F.filter("found", lambda x: (x["top"] == step["top"]) & (x["level"] == step["level"])), F.lit(0))["digests"]

    def beside(step: Column) -> Column:
        sides = (F.slice(run_of(step), F.lit(1), step["at"]), F.slice(run_of(step), step["at"] + 2, F.lit(fan)))
        return F.struct(*(F.array_join(x, "").alias(c) for x, c in zip(sides, ("before", "after"), strict=True)))

    runs = runs.withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
    first = F.get(F.filter("steps", lambda s: s["top"] & (s["level"] == 0)), F.lit(0))  # absent from a lone group's path
    own_subroot = F.get(run_of(first), first["at"])
    upper = F.transform("steps", beside)
    runs = runs.select("size", "children", F.coalesce(own_subroot, root).alias("subroot"), upper.alias("upper"))
    own = runs.select("size", "subroot", "upper", "children", F.posexplode("children").alias("__i", "c"))
    sides = (F.slice("children", F.lit(1), F.col("__i")), F.slice("children", F.col("__i") + 2, F.lit(fan)))
    before, after = (F.array_join(F.transform(x, lambda c: c["digest"]), "") for x in sides)
    lowest = F.array(F.struct(before.alias("before"), after.alias("after")))
    path = F.when(F.col("size") == 1, F.col("upper")).otherwise(F.concat(lowest, F.col("upper")))
    return own.select(*(F.col(f"c.x{i}").alias(c) for i, c in enumerate(extra)), F.col("c.digest").alias("leaf"), "subroot", root.alias("root"), path.alias("path"))


def proof(path: Column) -> Column:
    """The digests beside a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path give."""
    return F.aggregate(path, leaf, lambda now, s: digest(F.concat(s["before"], now, s["after"])))
