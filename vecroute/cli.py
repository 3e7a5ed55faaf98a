"""Command line: ``python -m vecroute.cli build|search|estimate|fetch|convert|merge|compare|scan|plot``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecroute import engine
from vecroute.config import load_config
from vecroute.functions.storage import write_text
from vecroute.operators import analysis
from vecroute.operators.experiments import convert_with_manifest, diagnostics_sink, estimate_runtime
from vecroute.sources.fetch import fetch_slice
from vecroute.sources.index import merge_indexes
from vecroute.sources.vectors import read_vectors


LOG = logging.getLogger("vecroute")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecroute")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "search", "estimate"):
        c = sub.add_parser(name)
        c.add_argument("config")
        c.add_argument("--datapath")
        c.add_argument("--result-dir")
        c.add_argument("--index-path")
        c.add_argument("--log", help="a file of the driver's, to which its log goes as well")
        c.add_argument("--skip-sanity-checks", action="store_true", help="let settings pass that a run to be kept must not have")
        if name == "build":
            c.add_argument("--tree-index", type=int)
            c.add_argument("--batch-train", type=_positive, help="rows of a block whose gradients are summed at once")
            c.add_argument("--batch-tree-update", type=_positive, help="vectors that a task scores at once")
            c.add_argument("--diagnostics", action="store_true", help="try each cycle's router and tree on the queries")
            c.add_argument("--diagnostics-path", help="folder of the rows; <result dir>/cycle-diagnostics unless given")
            c.add_argument("--diagnostics-queries", type=_positive, help="so many queries; all unless given")
            c.add_argument("--diagnostics-pairs", type=_positive, default=100_000, help="pairs of a loss")
        elif name == "search":
            c.add_argument("--num-leaves", type=int, nargs="+")
            c.add_argument("--n-queries", type=int)
            c.add_argument("--batch-search", type=_positive, help="queries that a task searches for at once")
    c = sub.add_parser("fetch", help="the first vectors of a large file, by ranges, resumed where it broke off")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--rows", type=_positive, required=True)
    c.add_argument("--piece-rows", type=_positive, default=262_144)
    c.add_argument("--suffix", default=".u8bin")
    c = sub.add_parser("convert", help="a vector file as Parquet in single precision, with a manifest of checksums")
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("merge")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--output", required=True)
    c = sub.add_parser("compare")
    c.add_argument("baseline")
    c.add_argument("treatment")
    c = sub.add_parser("scan")
    c.add_argument("path")
    c.add_argument("--min-recall", type=float)
    c.add_argument("--max-recall", type=float)
    c.add_argument("--config")
    c.add_argument("--sort", choices=("qps", "recall", "candidates", "source"), default="source")
    c.add_argument("--csv")
    c = sub.add_parser("plot")
    c.add_argument("curves", nargs="+")
    c.add_argument("--output", required=True)
    return p


def _positive(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return int(text)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vecroute").getOrCreate()
    if args.command == "merge":
        print(merge_indexes(spark, args.inputs, args.output))
    elif args.command == "fetch":
        fetch_slice(spark, args.source, args.target, args.rows, args.piece_rows, args.suffix).groupBy("fetched").agg(F.count("*").alias("pieces"), F.sum("rows").alias("rows")).show()
    elif args.command == "convert":
        convert_with_manifest(read_vectors(spark, args.source), args.target).coalesce(1).write.json(f"{args.target}-manifest")
    elif args.command == "compare":
        curves = analysis.read_curve(spark, args.baseline, "baseline").unionByName(analysis.read_curve(spark, args.treatment, "treatment"))
        analysis.by_leaves(curves, "baseline", "treatment").orderBy("leaves").show(truncate=False)
        analysis.compare(curves, "baseline", "treatment").orderBy("target").show(truncate=False)
        analysis.balance_warnings(curves, "baseline", "treatment").show(truncate=False)
    elif args.command == "scan":
        rows = analysis.filter_measurements(analysis.scan_logs(spark, args.path), args.min_recall, args.max_recall, args.config)
        points = rows.orderBy("host", "gpu", F.desc(args.sort) if args.sort != "source" else args.sort, "knob")
        if args.csv:
            points.coalesce(1).write.mode("overwrite").csv(args.csv, header=True)
        else:
            points.show(1000, truncate=False)
        report = analysis.qps_by_machine(rows).orderBy("host", "gpu").collect()
        if len(report) > 1:
            print("note: throughput of different machines is not comparable", file=sys.stderr)
        for r in report:
            print(r.asDict())
        return 0 if report else 1
    elif args.command == "plot":
        points = None
        for path in args.curves:
            one = analysis.read_curve(spark, path)
            points = one if points is None else points.unionByName(one)
        write_text(spark, args.output, analysis.render_svg(points))
    else:
        cfg = load_config(args.config).override(
            dataset__path=args.datapath, experiment__output_dir=args.result_dir,
            evaluation__num_leaves=getattr(args, "num_leaves", None), evaluation__num_queries=getattr(args, "n_queries", None),
        ).checked(args.skip_sanity_checks)
        if args.log:
            logging.basicConfig(filename=args.log, level=logging.INFO, format="%(asctime)s %(message)s", force=True)
        if rows := getattr(args, "batch_tree_update", None) or getattr(args, "batch_search", None):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        if args.skip_sanity_checks and cfg.problems():
            LOG.warning("note: unchecked settings: %s", "; ".join(cfg.problems()))
        for line in cfg.advice():
            LOG.warning("note: %s", line)
        index = args.index_path or f"{cfg.experiment.output_dir}/index"
        vectors = engine.load_database(spark, cfg)
        if args.command == "build":
            out = cfg.experiment.output_dir
            probe = engine.probe(spark, cfg, vectors, most=args.diagnostics_queries) if args.diagnostics else None
            sink = diagnostics_sink(spark, args.diagnostics_path or f"{out}/cycle-diagnostics") if args.diagnostics else None
            engine.write_run(spark, cfg, out)
            changed = {"loss_pairs": args.diagnostics_pairs if sink else None, "block_rows": args.batch_train}
            built = engine.build(spark, cfg, vectors, index, args.tree_index, probe, sink, **changed)
            engine.write_rows(spark, out, "build", built["trees"])
        elif args.command == "estimate":
            found = estimate_runtime(vectors, cfg.train_settings(), cfg.model.num_trees, cfg.training.cycles() or 1)
            write_text(spark, f"{cfg.experiment.output_dir}/estimate.json", json.dumps(found, indent=1))
            print(json.dumps(found))
        else:
            queries, truth = engine.load_queries(spark, cfg)
            engine.write_rows(spark, cfg.experiment.output_dir, "metrics", engine.sweep(spark, cfg, vectors, queries, truth, f"{index}/index"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
