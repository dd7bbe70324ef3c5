"""Command line: stats, inspect, verify, compact, get, version.

Exit codes: 0 done, 1 it couldn't run, 2 wrong usage, 3 damage found, 4 no such document.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from loomspark.types import FORMAT_VERSION, Config, EngineError, Include

VERSION = "0.1.0"


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomspark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("stats", "inspect", "verify", "compact", "get"):
        own = commands.add_parser(name)
        own.add_argument("path")
        own.add_argument("--json", action="store_true")
        if name == "verify":
            own.add_argument("--level", choices=("quick", "checksums", "full"), default="full")
        if name == "compact":
            own.add_argument("--ratio", type=float, default=0.3)
        if name == "get":
            own.add_argument("collection")
            own.add_argument("id")
    return parser.parse_args(argv)


def _show(found: Any, as_json: bool) -> None:
    if as_json:
        print(json.dumps(found, default=str, sort_keys=True))
    else:
        for k, v in found.items():
            print(f"{k}: {v}")


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = _arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "version":
        print(f"loomspark {VERSION}, format {FORMAT_VERSION}")
        return 0
    from pyspark.sql import SparkSession

    from loomspark.database import Database

    spark = spark or SparkSession.builder.appName("loomspark").getOrCreate()
    try:
        with Database(spark, args.path, Config(create_if_missing=False, read_only=args.command != "compact")) as db:
            if args.command == "stats":
                _show(db.stats(), args.json)
            elif args.command == "inspect":
                _show({"manifest": db.state["version"], "collections": {n: db.state["collections"][n] for n in db.list_collections()}}, args.json)
            elif args.command == "verify":
                report = db.verify(args.level)
                _show({"clean": report.is_clean, "errors": report.errors, "warnings": report.warnings, "segments": report.segments_checked}, args.json)
                return 0 if report.is_clean else 3
            elif args.command == "compact":
                _show(db.compact(args.ratio), args.json)
            else:
                own = db.collection(args.collection)
                found = own.get(int(args.id) if own.spec.id_kind == "u64" else args.id, Include(True, True, True))
                if found is None:
                    print(f"no document {args.id!r}", file=sys.stderr)
                    return 4
                _show({"id": found.id, "vector": found.vector, "metadata": found.metadata, "content_bytes": None if found.content is None else len(found.content)}, args.json)
        return 0
    except (EngineError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
