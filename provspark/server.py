"""A thin adapter: one JSON request per input line, one JSON response per output line.

Request: {"id": ..., "tool": name, "arguments": {...}}.  Response: {"id", "result"}
or {"id", "error": {"type", "message"}}.  Responses longer than ``max_chars`` are
errors, never cut.
"""

from __future__ import annotations

import json
import sys
from typing import IO

from pyspark.sql import DataFrame

from .engine import Engine
from .operators.filters import FilterSet

#: Bounds of a request.
MAX_QUERY_CHARS, MAX_LIMIT, MAX_LIST = 1_000_000, 1_000, 100


def filters_from(arguments: dict) -> FilterSet:
    lists = {}
    for name in ("documents", "exclude_documents", "authorities", "heading_prefix"):
        values = arguments.get(name) or []
        if len(values) > MAX_LIST:
            raise ValueError(f"{name}: more than {MAX_LIST} values")
        lists[name] = tuple(values) if name == "heading_prefix" else frozenset(values)
    return FilterSet(**lists, authority_floor=arguments.get("authority_floor"), scope=arguments.get("scope"))


def _query(a: dict) -> str:
    text = a["query"]
    if len(text) > MAX_QUERY_CHARS:
        raise ValueError("query is too long")
    return text


def _limit(a: dict) -> int:
    return max(1, min(int(a.get("limit", 10)), MAX_LIMIT))


TOOLS = {
    "sync_workspace": lambda e, a: e.sync(),
    "index_workspace": lambda e, a: e.sync(),
    "index_status": lambda e, a: e.report(),
    "list_documents": lambda e, a: e.store.table("documents").orderBy("path"),
    "document_outline": lambda e, a: e.outline(a["path"]),
    "get_section": lambda e, a: e.section(a["section_id"]),
    "get_lines": lambda e, a: e.lines(a["path"], int(a["first"]), int(a["last"])),
    "search": lambda e, a: e.search(_query(a), _limit(a), filters_from(a)),
    "search_exact": lambda e, a: e.search_exact(_query(a), _limit(a), filters_from(a)),
    "find_symbol": lambda e, a: e.find_symbol(a["symbol"], _limit(a), filters_from(a)),
    "get_references": lambda e, a: e.references(a["section_id"], bool(a.get("incoming"))),
    "get_dependencies": lambda e, a: e.dependencies(a["section_id"]),
    "get_checkpoint": lambda e, a: e.checkpoint(a["checkpoint_id"], a.get("document")),
    "get_checkpoint_context": lambda e, a: e.checkpoint_context(a["checkpoint_id"], a.get("document"), int(a.get("budget", 15_000)), bool(a.get("strict"))),
    "get_context_pack": lambda e, a: e.context_pack(a["task"], int(a.get("budget", 7000)), filters_from(a), bool(a.get("strict")), bool(a.get("require_semantic"))),
}


def answer(engine: Engine, request: dict, max_chars: int = 200_000) -> dict:
    """The response to one request; failures are typed, never raised."""
    try:
        out = TOOLS[request["tool"]](engine, request.get("arguments") or {})
        result = [r.asDict(recursive=True) for r in out.toLocalIterator()] if isinstance(out, DataFrame) else out
        response = {"id": request.get("id"), "result": result}
        if len(json.dumps(response, default=str, ensure_ascii=False)) > max_chars:
            raise ValueError(f"the response exceeds {max_chars} characters; ask for less")
        return response
    except KeyError as missing:
        return {"id": request.get("id"), "error": {"type": "InvalidRequest", "message": f"unknown or missing: {missing}"}}
    except (ValueError, RuntimeError) as failure:
        return {"id": request.get("id"), "error": {"type": type(failure).__name__, "message": str(failure)}}


def serve(engine: Engine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            response = answer(engine, json.loads(line))
        except json.JSONDecodeError as bad:
            response = {"id": None, "error": {"type": "InvalidRequest", "message": str(bad)}}
        print(json.dumps(response, default=str, ensure_ascii=False), file=sink, flush=True)
