"""Places of rows in the order of their group, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise


def places(rows: DataFrame, group: list[str], order: list[Column], into: str = "place", name: str = "places") -> DataFrame:
    """``rows`` with their place, from 1, in their group by ``order``, which must tell all rows of a group apart.

    One sort by ranges of (group, order) spreads a large group over many ranges. A range's rows of a group stand
    together, so a place is the row's number, less the first of them, and the counts of the ranges before."""
    keys = [*map(F.col, group), *order]
    made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__no", F.monotonically_increasing_id())
    made = materialise(made.withColumn("__range", F.shiftright("__no", 33).cast("int")), name)
    counts = made.groupBy(*group, "__range").agg(F.min("__no").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    spans = materialise(spans.withColumnsRenamed({c: f"__g_{c}" for c in [*group, "__range"]}), f"{name}-spans")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group], F.col("__range") == F.col("__g___range"))
    here = made.join(spans, same).withColumn(into, F.col("__no") - F.col("__first") + F.col("__base") + 1)
    return here.select(*rows.columns, into)
