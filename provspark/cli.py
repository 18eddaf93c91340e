"""Command line over the engine: JSON lines on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import open_engine
from .operators.filters import FilterSet

COMMANDS = {
    "init": (), "sync": (), "index": (), "status": (), "docs": (), "doctor": (), "log": (), "add": ("path",), "remove": ("path",), "rename": ("path", "new"), "outline": ("path",), "section": ("id",),
    "search": ("query",), "exact": ("query",), "lexical": ("query",), "semantic": ("query",), "find": ("symbol",), "refs": ("id",), "deps": ("id",), "checkpoint": ("id",),
    "checkpoint-context": ("id",), "pack": ("task",),
}
SEARCHES = ("search", "exact", "lexical", "semantic", "find")
BUDGETS = {"pack": 7000, "checkpoint-context": 15_000}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provspark")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if name == "add":
            c.add_argument("--authority", type=int, default=3)
            c.add_argument("--priority", type=int, default=0)
        if name in SEARCHES:
            c.add_argument("--limit", type=int, default=10)
        if name in (*SEARCHES, "pack"):
            c.add_argument("--document", action="append", default=[])
            c.add_argument("--exclude-document", action="append", default=[])
            c.add_argument("--authority-floor", type=int)
            c.add_argument("--scope")
            c.add_argument("--heading-prefix", action="append", default=[])
        if name in BUDGETS:
            c.add_argument("--budget", type=int, default=BUDGETS[name])
            c.add_argument("--strict", action="store_true")
        if name.startswith("checkpoint"):
            c.add_argument("--in-document")
        if name == "refs":
            c.add_argument("--incoming", action="store_true")
    lines = sub.add_parser("lines")
    for a, kind in (("path", str), ("first", int), ("last", int)):
        lines.add_argument(a, type=kind)
    return p


def filters(a: argparse.Namespace) -> FilterSet:
    return FilterSet(frozenset(a.document), frozenset(a.exclude_document), a.authority_floor, scope=a.scope, heading_prefix=tuple(a.heading_prefix))


def run(engine, a: argparse.Namespace):
    calls = {
        "init": lambda: engine.init(),
        "sync": lambda: engine.sync(),
        "index": lambda: engine.sync(),
        "status": lambda: engine.report(),
        "docs": lambda: engine.store.table("documents").orderBy("path"),
        "doctor": lambda: engine.report() | {"manifest": engine.store.manifest()},
        "log": lambda: engine.generation_log(),
        "add": lambda: engine.add(a.path, a.authority, a.priority),
        "remove": lambda: engine.remove(a.path),
        "rename": lambda: engine.rename(a.path, a.new),
        "outline": lambda: engine.outline(a.path),
        "section": lambda: engine.section(a.id),
        "lines": lambda: engine.lines(a.path, a.first, a.last),
        "search": lambda: engine.search(a.query, a.limit, filters(a)),
        "exact": lambda: engine.search_exact(a.query, a.limit, filters(a)),
        "lexical": lambda: engine.search_lexical(a.query, a.limit, filters(a)),
        "semantic": lambda: engine.search_semantic(a.query, a.limit, filters(a)),
        "find": lambda: engine.find_symbol(a.symbol, a.limit, filters(a)),
        "refs": lambda: engine.references(a.id, a.incoming),
        "deps": lambda: engine.dependencies(a.id),
        "checkpoint": lambda: engine.checkpoint(a.id, a.in_document),
        "checkpoint-context": lambda: engine.checkpoint_context(a.id, a.in_document, a.budget, a.strict),
        "pack": lambda: engine.context_pack(a.task, a.budget, filters(a), a.strict),
    }
    return calls[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    engine = open_engine(SparkSession.builder.appName("provspark").getOrCreate(), a.root)
    try:
        out = run(engine, a)
    except (ValueError, RuntimeError) as error:
        print(json.dumps({"error": type(error).__name__, "message": str(error)}), file=sys.stderr)
        return 2
    rows = [{}] if out is None else [out] if isinstance(out, dict) else (r.asDict(recursive=True) for r in out.toLocalIterator())
    for row in rows:
        print(json.dumps(row, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
