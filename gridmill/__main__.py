"""Command line: export tables, extract by a profile, evaluate a manifest, or list the profiles.

Exit codes of ``extract``: 0 all accepted, 2 some need review, 3 some rejected; of
``evaluate``: 0 all minimums reached, 1 not.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import api
from .plans.session import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridmill")
    todo = parser.add_subparsers(dest="command", required=True)
    tables = todo.add_parser("tables", help="export all tables below a path")
    extract = todo.add_parser("extract", help="extract by a profile")
    for p in (tables, extract):
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--kind", choices=("xlsx", "csv", "json"), default="csv")
    tables.add_argument("--no-merge", action="store_true", help="do not stitch tables across pages")
    extract.add_argument("--profile", default="lab-coa-v1")
    todo.add_parser("profiles", help="list the built-in profiles")
    measure = todo.add_parser("evaluate", help="hold extractions against ground truth")
    measure.add_argument("manifest")
    measure.add_argument("--output", help="also store the report here")
    given = parser.parse_args(arguments)
    spark = session()
    if given.command == "profiles":
        api.list_extraction_profiles(spark).show(truncate=False)
        return 0
    if given.command == "evaluate":
        report = api.evaluate_manifest(spark, given.manifest, given.output)
        print(json.dumps(report, indent=2))
        return 0 if report["passed"] else 1
    if given.command == "tables":
        api.export_document_tables(spark, given.input, given.output, given.kind, not given.no_merge).show(truncate=False)
        return 0
    done = api.export_with_profile(spark, given.input, given.profile, given.output, given.kind)
    counts = {r["decision"]: r["count"] for r in done.groupBy("decision").count().collect()}
    print(counts)
    return 3 if counts.get("rejected") else 2 if counts.get("needs_review") else 0


if __name__ == "__main__":
    sys.exit(main())
