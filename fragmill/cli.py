"""Command line: init builds an index, query asks it, info tells what it holds.

Exit codes: 0 for success, 1 for nothing found or no index, 2 for wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from fragmill.session import local_session

INDEX_NAME = ".fragmill"


def find_index(start: str) -> str | None:
    """The index of this directory or of the nearest one above it."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, INDEX_NAME, "meta.json")):
            return os.path.join(at, INDEX_NAME)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fragmill")
    sub = parser.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("root")
    init.add_argument("--language", action="append", default=None)
    init.add_argument("--out")
    ask = sub.add_parser("query")
    ask.add_argument("text")
    ask.add_argument("--index")
    ask.add_argument("--limit", type=int, default=20)
    ask.add_argument("--route", choices=("lexical", "planned"), default="lexical")
    info = sub.add_parser("info")
    info.add_argument("--index")
    try:
        args = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    from fragmill.project import Project, build

    spark = local_session()
    if args.command == "init":
        out = args.out or os.path.join(args.root, INDEX_NAME)
        meta = build(spark, out, [(args.root, lang) for lang in args.language or ["python", "java"]], name=os.path.basename(os.path.abspath(args.root)))
        print(json.dumps(meta))
        return 0 if meta["counts"]["symbols"] else 1
    path = args.index or find_index(".")
    if path is None:
        print("no index here or above; build one with: fragmill init ROOT", file=sys.stderr)
        return 1
    project = Project(spark, path)
    if args.command == "info":
        print(json.dumps(project.describe()))
        return 0
    result = project.search(args.text, route=args.route, limit=args.limit)
    for note in result.notes:
        print(f"# {note}", file=sys.stderr)
    rows = result.hits.collect()
    for r in rows:
        print(f"{r['rank']:>3}  {r.score:.4f}  {r.kind:<12} {r.name}  {r.file}  {r.why or ''}")
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
