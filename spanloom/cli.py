"""Command line: ``python -m spanloom.cli analyze|profiles|try ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from spanloom.catalog import Pattern, Registry, profile_from_yaml
from spanloom.plans.engine import Engine
from spanloom.plans.harness import try_patterns
from spanloom.sources import sinks
from spanloom.sources.files import load_options

FORMS = {"json": sinks.as_json, "wire": sinks.as_wire, "summary": sinks.as_summary}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="analyse a text, a file, or standard input")
    a.add_argument("text", nargs="?")
    a.add_argument("--file", type=Path, help="is read in the place of the text")
    a.add_argument("--profile", action="append", help="may be repeated")
    a.add_argument("--profile-file", type=Path, action="append", default=[], help="a YAML profile")
    a.add_argument("--options", type=Path, help="a YAML file of options")
    a.add_argument("--min-confidence", type=float)
    a.add_argument("--form", choices=[*FORMS, "table"], default="json")
    sub.add_parser("profiles", help="list the profiles")
    t = sub.add_parser("try", help="try a regular expression on texts")
    t.add_argument("regex")
    t.add_argument("texts", nargs="+")
    t.add_argument("--score", type=float, default=0.85)
    t.add_argument("--min-score", type=float, default=0.5)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "profiles":
        Registry().listing(spark).show(truncate=False)
        return 0
    if args.command == "try":
        try_patterns(spark, [Pattern("Tried", "TRIED", "tried", args.score, args.regex)], args.texts, args.min_score).show(truncate=False)
        return 0
    text = args.file.read_text(encoding="utf-8", errors="replace") if args.file else args.text if args.text is not None else sys.stdin.read()
    registry = Registry(map(profile_from_yaml, args.profile_file))
    chosen = args.profile or [profile_from_yaml(f).id for f in args.profile_file] or None
    result = Engine(chosen, load_options(args.options), registry).analyze_texts(spark, [text], min_confidence=args.min_confidence)
    if args.form == "table":
        sinks.entity_table(result, "idx").show(truncate=False)
    else:
        print(result.select(FORMS[args.form]().alias("x")).first().x)
    return 0


if __name__ == "__main__":
    sys.exit(main())
