"""Reading and comparing sweep curves and throughput logs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_STEP = re.compile(r'"(?:\\.|[^"\\\n])*"|[{}]')
CURVE_SCHEMA = "label string, leaves int, recall double, candidates double, qps double"


def read_curve(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(label, leaves, recall, candidates, qps) of a sweep's CSV; candidates under either of two names.

    Without ``label``, rows are told apart by what they say of themselves, so a file may hold several series;
    a file without rows is an error."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in ("mean_distcomp", "mean_n_distcomp") if c in raw.columns]
    if not names:
        raise ValueError(f"{path}: neither mean_distcomp nor mean_n_distcomp")
    if raw.isEmpty():
        raise ValueError(f"{path}: no rows")
    marks = [c for c in ("method", "model_id", "config") if c in raw.columns]
    series = F.lit(label) if label is not None else series_label(marks) if marks else F.lit(path)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return raw.select(
        series.alias("label"), number("knob_value").cast("int").alias("leaves"), number("recall@10").alias("recall"),
        F.coalesce(*map(number, names)).alias("candidates"), (number("qps") if "qps" in raw.columns else F.lit(None).cast("double")).alias("qps"),
    )


def segments(curve: DataFrame) -> DataFrame:
    """Consecutive points of each curve by recall: (label, lo, hi, c_lo, c_hi)."""
    w = Window.partitionBy("label").orderBy("recall", "candidates")
    return curve.select(
        "label", F.col("recall").alias("lo"), F.lead("recall").over(w).alias("hi"), F.col("candidates").alias("c_lo"), F.lead("candidates").over(w).alias("c_hi"),
    ).where("hi is not null")


def candidates_at_recall(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(label, target, candidates): by linear interpolation; null outside a curve's range.

    Targets are a short list, so each segment takes those that it spans; nothing is joined by range.
    """
    marks = F.array(*map(F.lit, targets))
    inside = segments(curve).withColumn("target", F.explode(F.filter(marks, lambda t: (t >= F.col("lo")) & (t <= F.col("hi")))))
    slope = F.when(F.col("hi") > F.col("lo"), (F.col("target") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    found = inside.groupBy("label", "target").agg(
        F.min(F.struct("lo", (F.col("c_lo") + slope * (F.col("c_hi") - F.col("c_lo"))).alias("c")))["c"].alias("candidates")
    )
    every = curve.select("label").distinct().withColumn("target", F.explode(marks))
    return every.join(found, ["label", "target"], "left")


def recall_targets(curve: DataFrame, baseline: str, treatment: str, n: int = 5) -> list[float]:
    """Evenly spaced recalls over the range that both curves cover; none if that is no more than a point."""
    ends = {r["label"]: r for r in curve.groupBy("label").agg(F.min("recall").alias("lo"), F.max("recall").alias("hi")).collect()}
    if not {baseline, treatment} <= set(ends):
        raise ValueError(f"no points of {baseline if baseline not in ends else treatment}")
    lo, hi = max(ends[baseline]["lo"], ends[treatment]["lo"]), min(ends[baseline]["hi"], ends[treatment]["hi"])
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if lo < hi else []


def balance_warnings(curve: DataFrame, baseline: str, treatment: str, tolerance: float = 0.05) -> DataFrame:
    """Budgets at which the two curves' candidates differ by more than ``tolerance`` of the baseline's."""
    a = curve.where(F.col("label") == baseline).select("leaves", F.col("candidates").alias("base"))
    b = curve.where(F.col("label") == treatment).select("leaves", F.col("candidates").alias("other"))
    drift = (F.col("other") - F.col("base")) / F.col("base")
    return a.join(b, "leaves").where(F.col("base") > 0).withColumn("drift", drift).where(F.abs("drift") > tolerance)


def compare(curve: DataFrame, baseline: str, treatment: str, n: int = 5) -> DataFrame:
    """(target, baseline, treatment, change) at recalls that both reach."""
    found = candidates_at_recall(curve, recall_targets(curve, baseline, treatment, n))
    wide = found.groupBy("target").pivot("label", [baseline, treatment]).agg(F.first("candidates"))
    return wide.withColumn("change", F.col(treatment) / F.col(baseline) - 1)


def by_leaves(curve: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """(leaves, candidates, recall_a, recall_b, delta) at budgets that both curves have."""
    a = curve.where(F.col("label") == baseline).select("leaves", "candidates", F.col("recall").alias("recall_a"))
    b = curve.where(F.col("label") == treatment).select("leaves", F.col("recall").alias("recall_b"))
    return a.join(b, "leaves").withColumn("delta", F.col("recall_b") - F.col("recall_a"))


def _objects(text: str) -> list[dict]:
    """The JSON objects of free text, without those inside others.

    One pass over braces and strings pairs each closing brace with the last open one; pairs are then tried
    from left to right, and those inside one that could be read are passed over. Braces without a partner,
    as in a file that was cut off, open nothing.
    """
    waiting, pairs = [], []
    for m in _STEP.finditer(text):
        if m[0] == "{":
            waiting.append(m.start())
        elif m[0] == "}" and waiting:
            pairs.append((waiting.pop(), m.end()))
    out, done = [], 0
    for a, z in sorted(pairs):
        if a >= done:
            try:
                out.append(json.loads(text[a:z]))
            except ValueError:
                continue
            done = z
    return out


def _points(found: dict) -> list[dict]:
    """An object with ``qps``, and those in its list of ``rows``; objects elsewhere in it are no points."""
    rows = found.get("rows")
    return [x for x in (found, *(rows if isinstance(rows, list) else [])) if isinstance(x, dict) and "qps" in x]


@udtf(returnType="point string")
class JsonMeasurements:
    """The measurements in a text, as JSON."""

    def eval(self, text: str):
        for found in _objects(text or ""):
            for point in _points(found):
                yield (json.dumps(point),)


def _fields(point: Column) -> dict[str, Column]:
    """What is known of a measurement: fields that are absent, or no numbers, are null."""
    m = F.from_json(point, "map<string,string>")
    recalls = F.filter(F.map_keys(m), lambda k: k.rlike("^recall@[0-9]+$"))  # not the counts and quantiles of it

    def number(*names: str) -> Column:
        return F.coalesce(*(m[n] for n in names)).try_cast("double")

    return {
        "qps": number("qps"), "recall": m[F.get(recalls, F.lit(0))].try_cast("double"), "candidates": number("mean_distcomp", "mean_n_distcomp"),
        "beam": number("beam_size").cast("int"), "knob": number("knob_value").cast("int"), "trees": number("num_trees").cast("int"),
        "config": F.coalesce(m["config"], m["model_id"], F.lit("")),
    }


def _host(text: Column) -> Column:
    """Of a line ``Job <id> on <host> ...``, the host; null without such a line."""
    words = F.transform(F.split(text, "\n"), lambda line: F.split(line, "\\s+"))
    lines = F.filter(words, lambda w: (F.get(w, F.lit(0)) == "Job") & (F.get(w, F.lit(2)) == "on"))
    return F.nullif(F.get(F.get(lines, F.lit(0)), F.lit(3)), F.lit(""))


def _gpu(text: Column) -> Column:
    """Of a device table's row ``| <n>  <name>    On | ...``, the name; null without such a row."""
    cells = F.transform(F.split(text, "\n"), lambda line: F.split(F.trim(F.get(F.split(line, "[|]"), F.lit(1))), "\\s{2,}"))
    rows = F.filter(cells, lambda c: (F.size(c) == 3) & c[0].rlike("^[0-9]+$") & F.startswith(c[1], F.lit("NVIDIA ")) & c[2].isin("On", "Off"))
    return F.get(F.get(rows, F.lit(0)), F.lit(1))


# Fixed value: the files that are read.
SUFFIXES = "*.{log,json,out,txt}"


def scan_logs(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Measurements of all log files below ``path``, with the host and GPU the file names (null if it doesn't).

    A file is one job's log, unless ``separator`` parts several in one file."""
    spark.udtf.register("json_measurements", JsonMeasurements)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES)
    logs = (files.text(path, lineSep=separator) if separator else files.text(path, wholetext=True)).select(
        F.col("_metadata.file_path").alias("source"), "value",
        _host(F.col("value")).alias("host"), _gpu(F.col("value")).alias("gpu"),
    )
    logs.createOrReplaceTempView("vecroute_logs")
    found = spark.sql("select m.point, l.host, l.gpu, l.source from vecroute_logs l, lateral json_measurements(l.value) m")
    return found.select(*(c.alias(name) for name, c in _fields(F.col("point")).items()), "host", "gpu", "source")


def filter_measurements(rows: DataFrame, min_recall: float | None = None, max_recall: float | None = None, config: str | None = None) -> DataFrame:
    for keep in (
        None if min_recall is None else F.col("recall") >= min_recall,
        None if max_recall is None else F.col("recall") <= max_recall,
        None if config is None else F.col("config").contains(config),
    ):
        rows = rows if keep is None else rows.where(keep)
    return rows


def qps_by_machine(rows: DataFrame) -> DataFrame:
    """Throughput is comparable on one machine only: best and median by (host, gpu)."""
    return rows.groupBy("host", "gpu").agg(
        F.count("*").alias("n_points"), F.max("qps").alias("best_qps"), F.median("qps").alias("median_qps"),
        F.max(candidates_per_second()).alias("best_candidates_per_second"),
    )


def candidates_per_second() -> Column:
    return F.when(F.col("candidates") > 0, F.col("qps") * F.col("candidates"))


def series_label(columns: list[str]) -> Column:
    """method[:model_id[:config]] of a sweep row, as far as given."""
    return F.concat_ws(":", *(F.nullif(F.col(c), F.lit("")) for c in columns))


def render_svg(points: DataFrame, width: int = 640, height: int = 400) -> str:
    """A recall-against-candidates chart of (label, recall, candidates): a curve's points are few."""
    from html import escape

    rows = points.where("recall is not null and candidates > 0").orderBy("label", "candidates").collect()
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"></svg>'
    top = max(r["candidates"] for r in rows)
    place = lambda r: (50 + (width - 70) * r["candidates"] / top, height - 40 - (height - 60) * r["recall"])
    parts = []
    labels = list(dict.fromkeys(r["label"] for r in rows))
    for i, label in enumerate(labels):
        colour = f"hsl({int(360 * i / len(labels))},60%,40%)"
        line = " ".join("{:.1f},{:.1f}".format(*place(r)) for r in rows if r["label"] == label)
        parts.append(f'<polyline fill="none" stroke="{colour}" points="{line}"/>')
        parts.append(f'<text x="60" y="{20 + 15 * i}" fill="{colour}">{escape(label or "")}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(parts)}</svg>'
