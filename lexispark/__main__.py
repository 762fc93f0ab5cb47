"""Command lines: the offline run, the index build, and the analysis report."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analysis, metrics
from .plans import index, offline
from .sources import readers, sinks


def _offline(spark: SparkSession, args: argparse.Namespace) -> dict:
    return offline.run_files(spark, args.config, args.output, args.base)


def _index(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = index.EncodingConfig(args.model, args.revision, checkpoint_rows=args.checkpoint_rows)
    module, _, name = args.encoder.partition(":")
    make = getattr(importlib.import_module(module), name)
    return index.build(spark, args.corpus, args.views, args.output, make, {"model": config.model, "revision": config.model_revision}, config.checkpoint_rows, resume=args.resume)


def _report(spark: SparkSession, args: argparse.Namespace) -> dict:
    joined = readers.analysis_tables(spark, args.queries, args.retrieval, args.predictions)
    attributed = analysis.macro_attribution(analysis.error_attribution(joined)).first().asDict()
    context = analysis.macro_means(analysis.context_metrics(joined, args.top_k)).first().asDict()
    pr = joined.select(metrics.analysis_precision("gold", "predicted").alias("p"), metrics.analysis_recall("gold", "predicted").alias("r")).agg(F.avg("p").alias("precision"), F.avg("r").alias("recall")).first().asDict()
    figures = {"Errors": attributed, "Context": context, "Predictions": pr}
    sinks.write_text(spark, f"{args.output}/report.md", sinks.markdown_report("Analysis", {k: list(v.items()) for k, v in figures.items()}))
    sinks.write_json(spark, f"{args.output}/report.json", figures)
    return figures


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexispark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("offline", help="a run configured by a TOML file")
    run.add_argument("config")
    run.add_argument("--output", required=True)
    run.add_argument("--base", help="folder of the configured paths; the file's own by default")
    run.set_defaults(call=_offline)
    build = commands.add_parser("build-index", help="encode the five views of a corpus")
    for name in ("--corpus", "--views", "--output", "--model", "--revision", "--encoder"):
        build.add_argument(name, required=True)
    build.add_argument("--checkpoint-rows", type=int, default=10_000)
    build.add_argument("--resume", action="store_true", help="go on with an interrupted build of the same inputs and settings")
    build.set_defaults(call=_index)
    report = commands.add_parser("report", help="errors, context metrics and precision of saved predictions")
    for name in ("--queries", "--retrieval", "--predictions", "--output"):
        report.add_argument(name, required=True)
    report.add_argument("--top-k", type=int, default=10)
    report.set_defaults(call=_report)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    print(json.dumps(args.call(spark or SparkSession.builder.appName("lexispark").getOrCreate(), args), indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
