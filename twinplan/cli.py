"""python -m twinplan.cli scan | check | fix | cleanup"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from twinplan import config as settings
from twinplan import report, service
from twinplan.functions.identifiers import VERIFIES, Refused, dialect_fold, resolve_dialect
from twinplan.sources import manifest, workspace


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinplan")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "check", "fix", "cleanup"):
        c = commands.add_parser(name)
        c.add_argument("--project-dir")
        c.add_argument("--dialect")
        c.add_argument("--format", choices=settings.FORMATS)
        if name in ("scan", "check"):
            c.add_argument("--fail-on", choices=settings.FAIL_ON)
        if name in ("check", "fix"):
            c.add_argument("--relation-prefix", help="what stands before a model's name in the catalog, as in `db.`")
            c.add_argument("--manifest", help="resolves calls; its dialect must agree with the others named")
            c.add_argument("--profiles-dir", help="where profiles.yml lies; the project's folder unless given")
            c.add_argument("--target")
        if name == "check":
            c.add_argument("--select")
            c.add_argument("--scratch-schema", help="compares through views made there, and dropped")
            c.add_argument("--ledger")
        if name == "fix":
            c.add_argument("model")
            c.add_argument("--dry-run", action="store_true")
        if name == "cleanup":
            c.add_argument("--run-id", required=True)
            c.add_argument("--scratch-schema")
    return top


def dialect_of(c: settings.Config, found: dict | None, given: dict) -> str:
    """What the settings, the manifest and the profile's target name; they must agree, and Spark must be able to run it. Spark's own where none names any."""
    named = found.get("metadata", {}).get("adapter_type") if found else None
    profile = workspace.profile_dialect(given["profiles_dir"] or c.project_dir, workspace.project_profile(c.project_dir), given["target"])
    every = [x for x in (c.dialect, named, profile) if x]
    dialect = resolve_dialect(*every) if every else "spark"
    if dialect not in VERIFIES:
        raise Refused("UNSUPPORTED_ADAPTER", f"{dialect} can be scanned, not checked")
    return dialect


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(_parser().parse_args(argv))
    try:
        c = settings.load(given)
        spark = spark or SparkSession.builder.getOrCreate()
        if given["command"] == "scan":
            rows = service.scan(spark, c.project_dir, dialect_fold(c.dialect or "spark")).collect()
            shown = {"json": lambda: report.scan_json(c.project_dir, rows) + "\n", "github": lambda: report.scan_annotations(rows), "text": lambda: report.scan_text(rows)}
            sys.stdout.write(shown[c.format]())
            return 2 if rows and c.fail_on == "finding" else 0
        if given["command"] == "cleanup":
            done = service.cleanup(spark, c.scratch_schema or "", given["run_id"])
            print(json.dumps(done))
            return 0 if done["complete"] else 1
        found = manifest.load(given["manifest"]) if given["manifest"] else None
        dialect = dialect_of(c, found, given)
        resolve = lambda call: f"{c.relation_prefix}{f'{call.source_name}_' if call.source_name else ''}{call.name}"
        if given["command"] == "check":
            ledger = workspace.Ledger(given["ledger"]) if given["ledger"] else None
            views = service.Views(spark, service.scratch_schema(c.scratch_schema), ledger) if c.scratch_schema else None
            receipts = service.check(spark, c.project_dir, resolve, dialect, given["select"], found, views)
            sys.stdout.write(report.check_json(c.project_dir, receipts) + "\n" if c.format == "json" else report.check_text(receipts))
            return report.exit_code(receipts, c.fail_on)
        receipt = service.fix(spark, c.project_dir, given["model"], resolve, dialect, given["dry_run"], found)
        sys.stdout.write(report.check_json(c.project_dir, [receipt], "fix") + "\n" if c.format == "json" else report.check_text([receipt]))
        return 0 if receipt.fixable else {"different": 3, "not_run": 0}.get(receipt.status, 4)
    except Refused as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
