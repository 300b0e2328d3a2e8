"""`python -m cairn.cli STORE COMMAND ...`: queries of a stored code map as JSON lines. Exit 0, 1 (failed) or 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from cairn.api import CodeMap


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("summary")
    for name in ("symbols", "find"):
        s = sub.add_parser(name)
        s.add_argument("text")
        s.add_argument("--limit", type=int, default=20)
    for name in ("entity", "relations", "usages", "surface", "pack"):
        sub.add_parser(name).add_argument("id", type=int)
    t = sub.add_parser("task")
    t.add_argument("text")
    t.add_argument("--query")
    t.add_argument("--seed", type=int)
    t.add_argument("--budget", type=int, default=4000)
    sub.add_parser("impacts").add_argument("ids", type=int, nargs="*")
    sub.add_parser("status")
    sub.add_parser("source").add_argument("path")
    r = sub.add_parser("route")
    r.add_argument("source", type=int)
    r.add_argument("target", type=int)
    r.add_argument("--via", type=int, action="append")
    r.add_argument("--max-depth", type=int, default=8)
    return p


def run(m: CodeMap, a: argparse.Namespace) -> object:
    if a.command == "summary":
        return m.summary()
    if a.command in ("symbols", "find"):
        return getattr(m, a.command)(a.text, limit=a.limit)
    if a.command == "route":
        return m.route(a.source, a.target, via=a.via, max_depth=a.max_depth)
    if a.command == "task":
        return m.prepare_task(a.text, a.query, a.seed, budget=a.budget)
    if a.command == "impacts":
        return m.impacts(a.ids)
    if a.command == "status":
        return m.status(m.generation)
    if a.command == "source":
        return m.source_file(a.path)
    if a.command == "entity":
        return m.entity(entity_id=a.id)
    return {"relations": m.relations_of, "usages": m.usages, "surface": m.surface, "pack": m.prepare_change}[a.command](a.id)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        out = run(CodeMap.open(spark, a.store), a)
    except (ValueError, LookupError, KeyError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    if isinstance(out, DataFrame):
        for row in out.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    else:
        print(json.dumps(asdict(out) if is_dataclass(out) else out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
