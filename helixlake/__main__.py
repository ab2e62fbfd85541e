"""Command line: ``python -m helixlake train|predict -c FILE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from helixlake.plans import annotate
from helixlake.sources.config import load_config, require

VERBS = {"train": "fit a model to the configured sequences and annotations", "predict": "write the segments of the configured sequences"}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="helixlake", description="Sequence annotation as Spark jobs.")
    verbs = made.add_subparsers(dest="verb", metavar="{train,predict,help}")
    for verb, text in VERBS.items():
        one = verbs.add_parser(verb, help=text, description=text)
        one.add_argument("-c", dest="config", metavar="FILE", help="TOML configuration (required)")
        one.add_argument("--strip-whitespace", action="store_true", help="white space inside FASTA lines is no base")
    verbs.add_parser("help", help="show this text")
    return made


def main(args: list[str] | None = None) -> int:
    """0: done, or help was asked for or shown because something is missing; 1: it failed."""
    made = parser()
    given = sys.argv[1:] if args is None else args
    if given and given[0] not in (*VERBS, "help", "-h", "--help"):
        print(f"Error: unknown command {given[0]!r}; there are help, {', '.join(VERBS)}", file=sys.stderr)
        made.print_help(sys.stderr)
        return 1
    if not given or given[0] in ("help", "-h", "--help"):
        made.print_help(sys.stderr)
        return 0
    found = made.parse_args(given)
    if not found.config:
        print("Error: -c FILE is missing", file=sys.stderr)
        made.print_help(sys.stderr)
        return 0
    try:
        config = load_config(found.config)
        require(config, found.verb)
    except (OSError, ValueError) as error:
        print(f"Error: {found.config}: {error}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName(f"helixlake {found.verb}").getOrCreate()
    try:
        if found.verb == "train":
            for r in annotate.train(spark, config, strip_whitespace=found.strip_whitespace).orderBy("epoch").collect():
                print(f"epoch {r['epoch'] + 1}: loss {r['loss']:.6f} over {r['windows']} windows")
        else:
            annotate.predict(spark, config, found.strip_whitespace)
    except Exception as error:  # noqa: BLE001
        print(f"Error: {found.verb} failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
