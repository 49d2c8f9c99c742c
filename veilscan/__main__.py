"""Batch jobs: ``python -m veilscan scan|fix|verify|rewrite``, or by spark-submit.

scan     scan a directory, print the summary, store what is reported
fix      turn the stored findings into a plan and log it
verify   compare the planned names with a table of names that are set
rewrite  write the rewritten files of a directory as a table
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import remediate, report
from .options import ScanOptions
from .session import checkpointed
from .sources import files, store


def options(args: argparse.Namespace) -> ScanOptions:
    base = ScanOptions()
    return ScanOptions(
        confidence_threshold=args.confidence,
        exclude_patterns=(*base.exclude_patterns, *args.exclude),
    )


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    """Exit status 1 if anything is reported.  The store is left as it is when
    nothing was found."""
    opts = options(args)
    found = report.at_least(files.scan_directory(spark, args.directory, opts=opts), opts.confidence_threshold)
    found = checkpointed(report.stored_form(found))
    row = report.summary(found).first()
    print(f"findings: {row['total']}  files: {row['files_affected']}")
    for band, n in row["by_confidence"].asDict().items():
        print(f"  {band}: {n}")
    for rule, n in sorted(row["by_rule"].items()):
        print(f"  {rule}: {n}")
    if row["total"]:
        store.save_findings(found, args.store)
    return 1 if row["total"] else 0


def fix(spark: SparkSession, args: argparse.Namespace) -> int:
    found = store.load_findings(spark, args.store)
    # The store keeps no scan order within a line; column and rule stand in.
    plan = remediate.migration_plan(found.withColumns({"kind": F.lit(1), "rule_ord": F.lit(0)}))
    plan = checkpointed(plan)
    plan.write.mode("overwrite").parquet(args.plan)
    store.log_migrations(plan, args.log)
    print(report.fix_summary(plan).first().asDict())
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Exit status 1 if a name is missing.  The table has name and value."""
    names = report.env_union(spark.read.parquet(args.plan), store.migration_log(spark, args.log))
    checked = report.env_check(names, spark.read.parquet(args.available))
    row = report.verify_summary(checked).first()
    print(row.asDict())
    return 0 if row["all_set"] else 1


def rewrite(spark: SparkSession, args: argparse.Namespace) -> int:
    plan = spark.read.parquet(args.plan)
    out = remediate.rewrite_files(files.read_files(plan.select("path").distinct()), plan)
    out.select("path", "text_after").write.mode("overwrite").parquet(args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilscan", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("scan")
    c.add_argument("directory")
    c.add_argument("--store", required=True)
    c.add_argument("--confidence", type=float, default=0.7)
    c.add_argument("--exclude", action="append", default=[])
    for name in ("fix", "verify", "rewrite"):
        c = commands.add_parser(name)
        c.add_argument("--plan", required=True)
        if name != "rewrite":
            c.add_argument("--log", required=True)
    commands.choices["fix"].add_argument("--store", required=True)
    commands.choices["verify"].add_argument("--available", required=True)
    commands.choices["rewrite"].add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veilscan").getOrCreate()
    return {"scan": scan, "fix": fix, "verify": verify, "rewrite": rewrite}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
