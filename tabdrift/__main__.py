"""Command line: diff two files, list what a file holds, normalise or diff project folders.

Exit codes: 0 no differences and complete, 1 otherwise, 2 an error that the caller can mend, 3 any other error."""

from __future__ import annotations

import argparse
import json
import sys
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabdrift")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff", help="compare two workbooks or BI packages")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--format", choices=("text", "json", "jsonl", "outcome", "payload"), default="text")
    d.add_argument("--out", help="folder for jsonl and payload")
    d.add_argument("--git-diff", action="store_true")
    d.add_argument("--preset", choices=("fastest", "balanced", "most_precise"), default="balanced")
    d.add_argument("--fast", action="store_const", const="fastest", dest="preset")
    d.add_argument("--precise", action="store_const", const="most_precise", dest="preset")
    d.add_argument("--quiet", action="store_true")
    d.add_argument("--database", action="store_true")
    d.add_argument("--sheet")
    d.add_argument("--keys", help="column letters, such as A,C")
    d.add_argument("--auto-keys", action="store_true")
    d.add_argument("--max-ops", type=int)
    d.add_argument("--timeout", type=float, help="seconds, after which running jobs are cancelled")
    d.add_argument("--metrics-json", help="file for the time it took")
    i = sub.add_parser("info", help="list sheets and queries")
    i.add_argument("path")
    g = sub.add_parser("project", help="project folders")
    how = g.add_subparsers(dest="action", required=True)
    n = how.add_parser("normalize")
    n.add_argument("path")
    n.add_argument("--profile", choices=("strict", "balanced", "aggressive"), default="balanced")
    n.add_argument("--out", required=True)
    f = how.add_parser("diff")
    f.add_argument("old")
    f.add_argument("new")
    f.add_argument("--profile", choices=("strict", "balanced", "aggressive"), default="balanced")
    f.add_argument("--markdown", action="store_true")
    return p


def _diff(spark, args) -> int:
    from . import api, sinks

    cfg = getattr(api.DiffConfig, args.preset)()
    if args.max_ops is not None:
        cfg = cfg.with_(max_ops=args.max_ops)
    if (args.keys or args.auto_keys or args.sheet) and not args.database:
        raise api.DiffError("BAD_OPTION", "--keys, --auto-keys and --sheet belong to --database")
    if args.keys and args.auto_keys:
        raise api.DiffError("BAD_OPTION", "either --keys or --auto-keys")
    if args.format in ("jsonl", "payload") and not args.out:
        raise api.DiffError("BAD_OPTION", f"--format {args.format} needs --out")
    if args.database:
        if not args.keys and not args.auto_keys:
            raise api.DiffError("BAD_OPTION", "--database needs --keys or --auto-keys")
        found = api.diff_database(spark, args.old, args.new, args.keys, args.sheet, cfg)
    elif args.old.lower().endswith((".pbix", ".pbit")):
        found = api.diff_bi(spark, args.old, args.new, cfg)
    else:
        found = api.diff_workbooks(spark, args.old, args.new, cfg)
    if args.git_diff:
        for line in found.git():
            print(line)
    elif args.format == "text":
        for line in found.text(args.quiet):
            print(line)
    elif args.format == "json":
        sinks.json_report(found.ops, found.warnings, sys.stdout)
    elif args.format == "outcome":
        print(json.dumps(found.outcome(), indent=2))
    elif args.format == "jsonl":
        sinks.json_lines(found.ops, args.out)
    else:
        for name, df in found.payload().items():
            df.write.mode("overwrite").json(f"{args.out}/{name}")
    return 0 if found.ops.isEmpty() and found.complete() else 1


def _project(spark, args) -> int:
    from . import api
    from .operators import project
    from .sources import project as folders

    if args.action == "normalize":
        project.snapshot(folders.documents(spark, args.path), args.profile).write.mode("overwrite").parquet(args.out)
        return 0
    found = api.diff_projects(spark, args.old, args.new, args.profile)
    if args.markdown:
        for line in found.markdown():
            print(line)
    else:
        for r in found.documents.orderBy("path").toLocalIterator():
            print(r["change"], r["path"])
    return 0 if found.documents.isEmpty() else 1


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from .api import DiffError

    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    start = time.monotonic()
    spark = spark or SparkSession.builder.getOrCreate()
    timer = None
    if getattr(args, "timeout", None):
        import threading

        timer = threading.Timer(args.timeout, spark.sparkContext.cancelAllJobs)
        timer.start()
    try:
        if args.command == "diff":
            return _diff(spark, args)
        if args.command == "info":
            from . import api

            for r in api.info(spark, args.path).orderBy("what", "position", "name").toLocalIterator():
                print(f"{r['what']}\t{r['name']}\t{r['detail']}")
            return 0
        return _project(spark, args)
    except (DiffError, AnalysisException, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"internal error: {e}", file=sys.stderr)
        return 3
    finally:
        if timer:
            timer.cancel()
        if getattr(args, "metrics_json", None):
            with open(args.metrics_json, "w") as f:
                json.dump({"seconds": round(time.monotonic() - start, 3)}, f)


if __name__ == "__main__":
    sys.exit(main())
