"""Command line: ``generate`` makes a strategy for review, ``redact`` executes one (or the default policy)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

import veilframe
from veilframe.operators.rules import RuleError, load_columns, load_patterns
from veilframe.plans.pipeline import Options, generate, redact
from veilframe.sources import strategy


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veilframe", description="Finds and masks sensitive values in documents.")
    verbs = out.add_subparsers(dest="verb")
    make = verbs.add_parser("generate", help="scan documents, write a strategy")
    run = verbs.add_parser("redact", help="mask documents by a strategy")
    for p in (make, run):
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-v", "--verbose", action="store_true")
        p.add_argument("--config", help="folder with pattern_rules.json and column_rules.json")
    which = run.add_mutually_exclusive_group(required=True)
    which.add_argument("-s", "--strategy")
    which.add_argument("--default-policy", action="store_true")
    run.add_argument("--operator", default="")
    run.add_argument("-f", "--force", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if not given.verb:
        print(f"veilframe {veilframe.__version__}")
        return 0
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    try:
        rules = {}
        if given.config:
            rules = {"patterns": load_patterns(Path(given.config) / "pattern_rules.json"), "columns": load_columns(Path(given.config) / "column_rules.json")}
        if given.verb == "generate":
            made = generate(spark, given.input, Options(**rules))
            Path(given.output).write_text(strategy.dump(made), encoding="utf-8")
            print(f"{len(made.sites)} sites, {len(made.column_rules)} column rules")
            return 0
        plan = strategy.load(Path(given.strategy).read_text(encoding="utf-8")) if given.strategy else None
        options = Options(given.operator, given.force, given.dry_run, **rules)
        rows = redact(spark, given.input, given.output, plan, options).orderBy("file").collect()
        for r in rows:
            print(f"{r['status']}: {r['file']}, {r['processed']} changed, {r['skipped']} skipped, {r['errors']} errors" + (f": {r['error']}" if r["error"] else ""))
        return int(any(r["status"] == "failed" for r in rows))
    except (RuleError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
