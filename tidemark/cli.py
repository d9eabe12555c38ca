"""Command line: run, resume, preflight, validate and health-check."""

from __future__ import annotations

import argparse
import json
import signal
import sys

from tidemark.plans.config import Config, ConfigError, load
from tidemark.plans.connect import source_of, target_of, types_of
from tidemark.plans.runner import EXIT_CODES, Runner


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--output-json", action="store_true")
    p.add_argument("--progress", action="store_true", help="a JSON line on stderr for each table")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "resume", "preflight", "validate", "health-check"):
        s = sub.add_parser(name)
        s.add_argument("--source-schema")
        s.add_argument("--target-schema")
        s.add_argument("--workers", type=int)
        if name == "run":
            s.add_argument("--dry-run", action="store_true")
    return p


def runner_of(spark, config: Config, progress: bool = False) -> Runner:
    source, target = source_of(spark, config.source), target_of(spark, config.target, config.source.kind())
    return Runner(spark, config, source, target, progress=(lambda e: print(json.dumps(e), file=sys.stderr, flush=True)) if progress else None, every=0.5 if progress else None)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        config = load(args.config)
        if args.workers:
            config.migration.workers = args.workers
        config.source.schema = args.source_schema or config.source.schema
        config.target.schema = args.target_schema or config.target.schema
        from pyspark.sql import SparkSession

        runner = runner_of(SparkSession.builder.getOrCreate(), config, args.progress)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return EXIT_CODES["config"]
    if args.command == "health-check":
        found = runner.health()
        print(json.dumps(found))
        return EXIT_CODES["ok" if found["healthy"] else "connection"]
    if args.command == "validate":
        rows = [r.asDict() for r in runner.validate().orderBy("table_name").collect()]
        print(json.dumps(rows))
        return EXIT_CODES["ok" if all(r["is_match"] for r in rows) else "validation"]
    if args.command == "preflight":
        found = runner.preflight(types_of(config.source.kind()), config.target.kind())
        rows = [r.asDict() for r in found.filter("n_refused > 0 OR is_lossy").orderBy("table_name", "column_name").collect()]
        print(json.dumps(rows))
        return EXIT_CODES["validation" if any(r["n_refused"] for r in rows) else "ok"]
    signal.signal(signal.SIGTERM, lambda *_: runner.cancel.set())
    result = runner.run(dry=getattr(args, "dry_run", False), resume=args.command == "resume")
    print(json.dumps(result.as_dict()) if args.output_json else f"{result.status}: {result.tables_success} of {result.tables_total} tables, {result.rows_transferred} rows")
    return result.exit_code()


if __name__ == "__main__":
    sys.exit(main())
