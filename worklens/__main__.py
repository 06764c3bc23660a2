"""Command line: ``python -m worklens run|preflight|check|where|forget|verdicts``. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from worklens.plans import pipeline
from worklens.sources import files, runs


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="worklens", description="Link and screen public-works spending records.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, said in (("run", "read the four extracts and write all tables"), ("preflight", "tell which extracts are missing")):
        command = commands.add_parser(name, help=said)
        for extract in pipeline.INPUTS:
            command.add_argument(f"--{extract.replace('_', '-')}", required=True, metavar="CSV")
        if name == "run":
            command.add_argument("--limit", type=int, help="only the first recommendations")
            command.add_argument("--out", required=True)
    commands.add_parser("check", help="tell which outputs of a run are missing").add_argument("--out", required=True)
    commands.add_parser("where", help="tell where the tables of the latest published run lie").add_argument("--out", required=True)
    forget = commands.add_parser("forget", help="delete earlier runs")
    forget.add_argument("--out", required=True)
    forget.add_argument("--keep", type=int, default=2, help="how many published runs stay")
    verdicts = commands.add_parser("verdicts", help="record a reviewer's verdicts, a CSV of review_id, human_verdict, human_notes")
    verdicts.add_argument("--out", required=True)
    verdicts.add_argument("--file", required=True)
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    """The exit code: 1 where something is missing or cannot be recorded."""
    args = _arguments(given)
    spark = SparkSession.builder.appName("worklens").getOrCreate()
    if args.command in ("run", "preflight"):
        paths = {k: getattr(args, k) for k in pipeline.INPUTS}
        if gone := files.missing_inputs(spark, *paths.values()):
            print("Missing inputs:", *gone, sep="\n  ")
            return 1
        print("All inputs are there." if args.command == "preflight" else files.as_json(pipeline.run_pipeline(spark, paths, args.out, args.limit)))
    elif args.command == "check":
        if gone := pipeline.missing_outputs(spark, args.out):
            print("Missing outputs:", *gone, sep="\n  ")
            return 1
        print("All outputs are there.")
    elif args.command == "where":
        if (found := runs.current(spark, args.out)) is None:
            print("No run is published.")
            return 1
        print(*(f"{name}: {args.out}/runs/{found['run']}/{name}" for name in found["outputs"]), sep="\n")
    elif args.command == "forget":
        print("Deleted runs:", *runs.forget(spark, args.out, args.keep), sep="\n  ")
    else:
        try:
            metrics = pipeline.record_verdicts(spark, args.out, files.read_extract(spark, args.file))
        except ValueError as wrong:
            print(wrong)
            return 1
        metrics.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
