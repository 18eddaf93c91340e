"""Symbols, checkpoint fields and assertions in section texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P

_SYMBOLS = [re.compile(p) for p in P.SYMBOLS.values()]
_IS = {n: re.compile(p) for n, p in P.SYMBOLS.items()}
_FIELD, _LIST = re.compile(P.FIELD_LINE), re.compile(P.LIST_LINE)
_MARKERS = [(family, polarity, re.compile(p)) for family, polarity, p in P.MARKERS]
_IDENTIFIER = re.compile(P.IDENTIFIER)
_DEPENDENCY, _MARK = re.compile(P.DEPENDENCY_LINE), re.compile(P.SECTION_MARK)


def symbol_kind(symbol: str) -> str:
    rules = [
        ("checkpoint", _IS["checkpoint"].fullmatch(symbol)),
        ("error_or_code", _IS["error"].fullmatch(symbol) or _IS["constant"].fullmatch(symbol)),
        ("cli_flag", _IS["cli_flag"].fullmatch(symbol)),
        ("file_symbol", _IS["file_symbol"].fullmatch(symbol)),
        ("namespace_symbol", "::" in symbol),
        ("qualified_identifier", "." in symbol or "@" in symbol),
        ("kebab_identifier", "-" in symbol),
    ]
    return next((kind for kind, holds in rules if holds), "type")


def origin(text: str, offset: int) -> str:
    """CODE inside a fence, INLINE_CODE inside back quotes, else PROSE."""
    before = text[:offset]
    if before.count("```") % 2 or before.count("~~~") % 2:
        return "CODE"
    return "INLINE_CODE" if before[before.rfind("\n") + 1 :].count("`") % 2 else "PROSE"


def symbols(text: str) -> list[dict]:
    places = {(m.start(), m[0]) for p in _SYMBOLS for m in p.finditer(text)}
    return [{"symbol": s, "offset": at, "kind": symbol_kind(s), "origin": origin(text, at)} for at, s in sorted(places)]


def _key(name: str) -> str | None:
    return P.FIELDS.get(" ".join(re.findall(r"[^\W_]+", name.casefold())))


def _values(lines: list[str]) -> list[str]:
    stripped = ((m[1] if (m := _LIST.match(x)) else x).strip() for x in lines if x.strip())
    return [x for x in stripped]


def checkpoint_fields(heading: str, body: str) -> list[dict]:
    """(field, position, value) of a section: its own heading's field, then its field lines."""
    lines = re.split(r"\r\n|\r|\n", body)
    found: list[tuple[str, str]] = []
    if own := _key(heading):
        found += [(own, v) for v in _values(lines)]
    n = 0
    while n < len(lines):
        m = _FIELD.match(lines[n])
        n += 1
        key = _key(m[1]) if m else None
        if key is None:
            continue
        if m[2].strip():
            found.append((key, m[2].strip()))
            continue
        end = n
        while end < len(lines) and not _FIELD.match(lines[end]) and not re.match(r"#{1,6}\s", lines[end]):
            end += 1
        found += [(key, v) for v in _values(lines[n:end])]
        n = end
    return [{"field": k, "position": i, "value": v} for i, (k, v) in enumerate(found)]


def dependency_texts(heading: str, text: str) -> list[str]:
    """What a section names as dependencies: the rest of a field line, the list after an
    empty one, or the whole body under a heading of that name."""
    lines, out = re.split(r"\r\n|\r|\n", text), []
    for n, line in enumerate(lines):
        m = _DEPENDENCY.match(line)
        if m and m[1].strip():
            out.append(m[1])
        elif m:
            listed: list[str] = []
            for x in lines[n + 1 :]:
                if _LIST.match(x):
                    listed.append(x)
                elif listed:
                    break
            out.append("\n".join(listed))
    if heading.strip().casefold() in ("dependency", "dependencies"):
        out.append("\n".join(lines[1:]))
    return [x for x in out if x.strip()]


def dependency_labels(heading: str, text: str) -> list[str]:
    """Checkpoints, section marks and symbols that a section depends on."""
    found: set[str] = set()
    for block in dependency_texts(heading, text):
        found |= {m[0] for m in _MARK.finditer(block)} | {s["symbol"] for s in symbols(block)}
    return sorted(found, key=str.casefold)


def _clauses(text: str):
    """Clauses of prose lines: fences, headings and bullet labels are left out."""
    fenced = False
    for line in re.split(r"\r\n|\r|\n", text):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif bare and not fenced and not bare.startswith("#"):
            yield from (c for c in re.split(r"[.!?;](?:\s|$)", re.sub(P.LEADING_FIELD, "", bare)) if c.strip())


def _property(tail: str) -> str:
    words = re.findall(r"[a-z0-9_-]+", re.sub(P.TRAILING_QUALIFIER, "", re.sub(r"[`*_]", "", tail)).casefold())
    return "-".join(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words if w not in P.PROPERTY_STOP_WORDS)


def _subject(clause: str, start: int, heading_ids: list[str], family: str) -> str | None:
    before = [m for m in _IDENTIFIER.finditer(clause, 0, start) if start - m.end() <= P.SUBJECT_WINDOW]
    if before:
        return before[-1][0]
    if not clause[:start].strip():
        return heading_ids[0] if len(heading_ids) == 1 else None
    words = [w for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]*", clause[max(0, start - P.SUBJECT_WINDOW) : start]) if w.casefold() not in P.SUBJECT_STOP_WORDS]
    return " ".join(words[-3:]) if words else None


def assertions(heading: str, text: str) -> list[dict]:
    """(family, polarity, subject, property) that the clauses of a section assert."""
    ids = sorted(set(_IDENTIFIER.findall(heading)))
    out = []
    for clause in _clauses(text):
        taken: list[tuple[int, int]] = []
        for family, polarity, pattern in _MARKERS:
            for m in pattern.finditer(clause):
                if any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                taken.append(m.span())
                subject = _subject(clause, m.start(), ids, family)
                if subject:
                    key = "-".join(re.findall(r"[^\W_]+", subject.casefold()))
                    out.append({"family": family, "polarity": polarity, "subject": key, "property": _property(clause[m.end() :]) if family == "modal" else "", "clause": clause.strip()})
    return out


def _struct(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t()) for n, t in fields.items()]))


@F.pandas_udf(_struct(symbol=T.StringType, offset=T.IntegerType, kind=T.StringType, origin=T.StringType))
def symbols_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: symbols(t or ""))


@F.pandas_udf(_struct(field=T.StringType, position=T.IntegerType, value=T.StringType))
def fields_of(headings: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([checkpoint_fields(h or "", t or "") for h, t in zip(headings, texts)])


@F.pandas_udf(_struct(family=T.StringType, polarity=T.IntegerType, subject=T.StringType, property=T.StringType, clause=T.StringType))
def assertions_of(headings: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([assertions(h or "", t or "") for h, t in zip(headings, texts)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def dependencies_of(headings: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([dependency_labels(h or "", t or "") for h, t in zip(headings, texts)])
