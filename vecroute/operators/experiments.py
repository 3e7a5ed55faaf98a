"""Controls around training: reassignment under other rules, runtime estimates, diagnostics on disk."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise, write_text
from vecroute.operators.metrics import leaf_divergence, leaf_size_stats
from vecroute.operators.training import TrainSettings, alternating_train, reassign
from vecroute.operators.shared_router import SharedRouter


@dataclass(frozen=True)
class Arm:
    """One way to assign: a mode and an order of visit."""

    name: str
    mode: str
    order: str


ARMS = [Arm(f"{m}_{o}", m, o) for m in ("round", "sequential") for o in ("input", "confidence")]


def reassign_arms(router: SharedRouter, vectors: DataFrame, source: DataFrame, settings: TrainSettings, arms: list[Arm] | None = None, drift: float | None = None) -> DataFrame:
    """(arm, moved, n_vectors, share, max, gini): all vectors assigned anew under each arm, against ``source``.

    With ``drift``, the arm of the settings' own rules must reproduce the source up to that share, or the
    comparison is void.
    """
    n, out = vectors.count(), None
    for arm in arms or ARMS:
        rules = replace(settings, mode=arm.mode, order=arm.order)
        paths = materialise(reassign(router, vectors, rules, n)[0], f"arm-{arm.name}")
        row = leaf_divergence(source, paths).join(leaf_size_stats(paths, settings.k, settings.h).select("tree_id", "max", "gini"), "tree_id")
        row = materialise(row.withColumn("arm", F.lit(arm.name)), "arm")
        if drift is not None and (arm.mode, arm.order) == (settings.mode, settings.order):
            moved = row.agg(F.max("share")).first()[0]
            if moved > drift:
                raise ValueError(f"{arm.name} moves {moved:.2%} of the vectors of its own index")
        out = row if out is None else out.unionByName(row)
    return out.select("arm", "moved", "n_vectors", "share", "max", "gini")


def executor_peaks(spark) -> list[dict]:
    """Of each executor (the driver, in local mode) the peaks in bytes that Spark has seen at its heartbeats."""
    out = []
    known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for i in range(known.size()):
        one = known.apply(i)
        peaks = one.peakMemoryMetrics()
        found = {name: peaks.get().getMetricValue(name) for name in PEAKS} if peaks.isDefined() else dict.fromkeys(PEAKS, 0)
        out.append({"executor": one.id(), "cores": one.totalCores(), "most_memory": one.maxMemory()} | found)
    return out


# Names of Spark's executor metrics.
PEAKS = ("JVMHeapMemory", "JVMOffHeapMemory", "OnHeapExecutionMemory", "OffHeapExecutionMemory", "ProcessTreePythonRSSMemory")


def estimate_runtime(vectors: DataFrame, settings: TrainSettings, n_trees: int, cycles: int) -> dict:
    """Seconds of one cycle of one tree, what that comes to for a whole build, and the executors' peaks by then."""
    began = time.perf_counter()
    alternating_train(vectors, replace(settings, max_cycles=1))
    cycle = time.perf_counter() - began
    return {"cycle_seconds": cycle, "tree_seconds": cycle * cycles, "build_seconds": cycle * cycles * n_trees, "executors": executor_peaks(vectors.sparkSession)}


def ablation(settings: TrainSettings, **choices: list) -> dict[str, TrainSettings]:
    """Settings for every combination of the choices, by name."""
    found = {"": settings}
    for key, values in choices.items():
        found = {f"{name}{'_' if name else ''}{key}-{v}": replace(s, **{key: v}) for name, s in found.items() for v in values}
    return found


def diagnostics_sink(spark, path: str) -> Callable[[dict], None]:
    """A sink for training that writes each row it gets as a file of the folder ``path``, in any store of Spark's.

    A name says which tree, cycle and stage it is of, so a run that goes on replaces what it does anew."""

    def write(row: dict) -> None:
        write_text(spark, f"{path}/tree-{row['tree']:04d}-cycle-{row['cycle']:04d}-{row['stage']}.json", json.dumps(row, sort_keys=True, default=str) + "\n")

    return write


def convert_with_manifest(vectors: DataFrame, path: str, kind: str = "float") -> DataFrame:
    """Write vectors as Parquet, never over something, and return (file, bytes, sha256, md5) of what was written.

    Sources in half precision come as numbers already; ``kind`` is the type that is kept."""
    vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).write.mode("errorifexists").parquet(path)
    return manifest(vectors.sparkSession, path)


def manifest(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")
    )


def verify_manifest(spark, path: str, expected: DataFrame) -> DataFrame:
    """Rows that differ from ``expected``: missing, new or changed files."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("found"))
    return expected.select("file", "sha256").join(now, "file", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found")))
