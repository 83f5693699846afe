"""Command line: ``python -m sieveline scan PATH...``, ``history REPO``, ``staged REPO``, ``rules``."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveline")
    parser.add_argument("--rules", action="append", default=[], help="a rule file or directory")
    parser.add_argument("--no-builtin", action="store_true")
    parser.add_argument("--providers", action="store_true", help="look for the published token formats of providers as well")
    parser.add_argument("--fingerprint-key-file", help="a file of 32 bytes; fingerprints are keyed with it")
    parser.add_argument("--min-confidence", choices=["low", "medium", "high"], default="low")
    parser.add_argument("--min-entropy", type=float)
    parser.add_argument("--no-base64", action="store_true")
    parser.add_argument("--max-bytes", type=int, default=64 << 20)
    parser.add_argument("--format", choices=["json", "jsonl", "sarif"], default="jsonl")
    kept = parser.add_mutually_exclusive_group()
    kept.add_argument("--baseline", help="report only what this kept baseline lacks")
    kept.add_argument("--write-baseline", help="keep the findings of a complete scan here, with the dispositions of what is there")
    commands = parser.add_subparsers(dest="command", required=True)
    scan_ = commands.add_parser("scan")
    scan_.add_argument("paths", nargs="+", help="files and directories; - alone is standard input")
    scan_.add_argument("--no-ignore", action="store_true")
    scan_.add_argument("--spread-archives", type=int, metavar="TASKS", help="cut large archives into parts and deal all inputs out over so many tasks")
    scan_.add_argument("--units", metavar="DIR", help="commit findings here, part by part of the folders; an interrupted scan reports what is committed, and goes on when run again")
    scan_.add_argument("--unit-folders", type=int, default=256, help="folders in a part")
    for name in ("history", "staged"):
        git_ = commands.add_parser(name)
        git_.add_argument("repo")
        if name == "history":
            git_.add_argument("--range")
    commands.add_parser("rules")
    given = parser.parse_args(args)

    from sieveline.operators.baseline import ContextError
    from sieveline.plans.rules import RuleError

    try:
        return _run(given)
    except (ContextError, RuleError) as e:
        print(f"sieveline: {e}", file=sys.stderr)
        return 2


def _key(path: str | None) -> str | None:
    from sieveline.plans.rules import RuleError

    if path is None:
        return None
    with open(path, "rb") as f:
        key = f.read(33)
    if len(key) != 32:
        raise RuleError("the fingerprint key file must hold exactly 32 bytes")
    return key.hex()


def _run(given: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sieveline.operators import baseline, report, scan
    from sieveline.plans import context as C
    from sieveline.plans import rules as R
    from sieveline.sources import archives, encodings, files, git

    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    config = scan.Config(
        tuple(r for p in given.rules for r in R.load(p)), not given.no_builtin, given.min_confidence, given.min_entropy, not given.no_base64,
        _key(given.fingerprint_key_file), given.max_bytes, given.providers,
    )
    if given.command == "rules":
        print(json.dumps([r.asDict() for r in R.inventory(spark, config.compiled()).collect()]))
        return 0
    if given.command == "scan" and given.units and given.paths == ["-"]:
        raise R.RuleError("--units needs files or directories: standard input cannot be read again")
    policy: list[bytes] = []
    if given.command == "scan":
        if given.paths == ["-"]:
            inputs, wrong = files.given(spark, sys.stdin.buffer, given.max_bytes)
            roots = ["-"]
            parts = [inputs.withColumn("error", F.lit(None).cast("string")).unionByName(wrong.select("path", F.col("path").alias("identity"), F.lit(None).cast("binary").alias("content"), F.col("message").alias("error")))]
        else:
            known = files.survey(given.paths, not given.no_ignore)
            roots, policy = known.roots, known.policy
            surveys = files.units(known, given.unit_folders) if given.units else [known]
            parts = [files.rows(spark, u, given.max_bytes).drop("length") for u in surveys]

        def searched(rows):
            # One pass: files are read, archives expanded, texts decoded and searched, inputs counted, errors carried along.
            rows = archives.expand(rows, given.max_bytes, given.spread_archives).withColumn("length", F.octet_length("content").cast("long"))
            rows, counted = report.observed(encodings.decoded(rows))
            space = F.when(F.col("is_member"), "archive_member_bytes").otherwise("source_bytes")
            return scan.findings(rows.drop("length"), config, space).drop("is_member"), counted

        if given.units:
            scanned = C.context(given.command, roots, config, policy)
            control = report.Control(spark, f"sieveline {os.getpid()}")
            with report.interrupts(control):
                all_, errors, stats = report.committed([(u.name(), *searched(p)) for u, p in zip(surveys, parts, strict=True)], given.units, control, scanned)
            found = all_.cache()
        else:
            all_, counted = searched(parts[0])
            all_ = all_.cache()
            all_.count()
            found, errors = scan.parted(all_)
            stats = report.told(spark, counted)
    elif given.command == "history":
        roots = [os.path.realpath(git.root(given.repo)), given.range or ""]
        found, errors = git.history(spark, given.repo, given.range, config, given.max_bytes)
        found, errors = found.drop("oid", "commit").cache(), errors.cache()
        stats = git.stats(git.history_entries(spark, given.repo, given.range), given.repo, given.max_bytes)
    else:
        roots = [os.path.realpath(git.root(given.repo))]
        found, errors = git.staged(spark, given.repo, config, given.max_bytes)
        found, errors = found.cache(), errors.cache()
        stats = git.stats(git.staged_entries(spark, git.root(given.repo)), given.repo, given.max_bytes)
    scanned = C.context(given.command, roots, config, policy)
    complete = errors.limit(1).count() == 0
    if given.write_baseline:
        old, own = baseline.read(spark, given.write_baseline) if baseline.exists(spark, given.write_baseline) else (None, None)
        baseline.write(baseline.from_findings(found, old, complete=complete, context=scanned, previous_context=own), given.write_baseline, scanned)
    if given.baseline:
        old, own = baseline.read(spark, given.baseline)
        found = baseline.diff(found, old, complete=complete, context=scanned, baseline_context=own)[0]
    closing = report.closed(report.summary(found, errors), stats, scanned)
    whole = {"sarif": lambda: report.sarif(found, errors), "json": lambda: report.document(found, errors, closing)}
    out = whole[given.format]() if given.format in whole else report.json_lines(found, errors, closing)
    for row in out.toLocalIterator():
        print(row[0])
    return closing.first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
