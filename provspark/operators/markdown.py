"""Markdown documents to sections and search windows.

The block scan and the window cut are sequential and run as Arrow functions, a
document (or section) at a time; ends, parents, paths and occurrences are window
functions over the headings.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_heading, chunk_id, section_id

#: The sizes of a search window in estimated tokens.
TARGET_TOKENS, MOST_TOKENS, OVERLAP_TOKENS = 320, 448, 48
#: Fixed value: a cut at white space is taken only beyond this share of a window.
CUT_SHARE = 0.82

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}|\t|$)")


def split_lines(text: str) -> list[str]:
    """Lines with their ends; CR, LF and CRLF end a line."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)


def front_matter_lines(lines: list[str]) -> int:
    """Number of leading lines that are front matter."""
    if not lines or lines[0].rstrip("\r\n") != "---":
        return 0
    for n, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            return n + 1
    return 0


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line from 0, level, heading) of all headings, also those inside quotes and lists."""
    lines = split_lines(text)
    out: list[tuple[int, int, str]] = []
    fence: tuple[str, int, int] | None = None  # mark, length, quote depth
    paragraph: list[str] = []
    begun, depth_before, indent = 0, 0, 0
    for n in range(front_matter_lines(lines), len(lines)):
        line = lines[n].rstrip("\r\n").expandtabs(4)
        depth = 0
        while (m := _QUOTE.match(line)) and (fence is None or depth < fence[2]):
            line, depth = line[m.end() :], depth + 1
        if fence:
            m = _FENCE.match(line[min(indent, len(line) - len(line.lstrip(" "))) :])
            if depth < fence[2]:
                fence = None
            elif m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                fence = None
                continue
            else:
                continue
        if depth != depth_before:
            paragraph, depth_before = [], depth
        if not line.strip():
            paragraph = []
            continue
        own = len(line) - len(line.lstrip(" "))
        if indent and own >= indent:
            line, own = line[indent:], own - indent
        elif not paragraph:
            indent = 0
        while (m := _ITEM.match(line)) and not _BREAK.match(line) and not (paragraph and m[3] == ""):
            if own >= 4:
                break
            indent = (indent if own else indent) + m.end()
            line = line[m.end() :]
            own = len(line) - len(line.lstrip(" "))
            paragraph = []
        if own >= 4 and not paragraph:
            continue  # indented code
        if m := _FENCE.match(line):
            if not (m[1][0] == "`" and "`" in m[2]):
                fence, paragraph = (m[1][0], len(m[1]), depth), []
                continue
        if m := _ATX.match(line):
            out.append((n, len(m[1]), (m[2] or "").strip() if not re.fullmatch(r"#+", m[2] or "") else ""))
            paragraph = []
            continue
        if paragraph and (m := _SETEXT.match(line)):
            out.append((begun, 1 if m[1][0] == "=" else 2, " ".join(p.strip() for p in paragraph)))
            paragraph = []
            continue
        if _BREAK.match(line):
            paragraph = []
            continue
        if not paragraph:
            begun = n
        paragraph.append(line)
    return out


def with_stops(found: list[tuple[int, int, str]]) -> list[dict]:
    """Headings with stop: the index of the next heading of no greater level, or their number."""
    out = [{"line": a, "level": b, "heading": c, "stop": len(found)} for a, b, c in found]
    open_ones: list[int] = []
    for n, (_, level, _) in enumerate(found):
        while open_ones and found[open_ones[-1]][1] >= level:
            out[open_ones.pop()]["stop"] = n
        open_ones.append(n)
    return out


_HEADING = [("line", T.IntegerType()), ("level", T.IntegerType()), ("heading", T.StringType()), ("stop", T.IntegerType())]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _HEADING])))
def scan_headings(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: with_stops(headings(t or "")))


def lines_of(text: Column) -> Column:
    """Lines with their ends; CR, LF and CRLF end a line, as in :func:`split_lines`, and an empty last line is kept."""
    return F.split(text, r"(?<=\n)|(?<=\r)(?!\n)", -1)


def line_offsets(documents: DataFrame, key: list[str], lines: Column) -> DataFrame:
    """key..., line, start, content: one row per line with its code-point offset, by a running sum."""
    rows = documents.select(*key, F.posexplode(lines).alias("line", "content"))
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content").cast("long") + 1).over(before), F.lit(0).cast("long"))
    return rows.withColumn("start", start)


def sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of documents(key, text, ...): one row per heading, and a level-0
    preamble where there is text before the first.

    key, ordinal, level, heading, start_line, end_line (exclusive, from 0),
    parent (ordinal or null), stop (ordinal after the last descendant, null for a
    preamble), heading_path, heading_path_key, occurrence, id.  A section runs to
    the next heading of any level.
    """
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    scanned = documents.select(key, n_lines.alias("n_lines"), scan_headings("text").alias("h"))
    first = F.when(F.size("h") > 0, F.get("h", F.lit(0))["line"])
    preamble = F.when(first.isNull() | (first > 0), F.expr("array(struct(0 as line, 0 as level, '[preamble]' as heading, cast(null as int) as stop))")).otherwise(F.expr("cast(array() as array<struct<line:int,level:int,heading:string,stop:int>>)"))
    # with a preamble, ordinals are one more than the headings' indexes
    stop = (F.col("x.stop") + F.size("preamble")).cast("long").alias("stop")
    rows = scanned.withColumn("preamble", preamble).select(key, "n_lines", "preamble", F.explode(F.concat("preamble", "h")).alias("x"))
    rows = rows.select(key, "n_lines", F.col("x.line").cast("long").alias("start_line"), F.col("x.level").cast("long").alias("level"), F.col("x.heading").alias("heading"), stop)
    w = Window.partitionBy(key).orderBy("start_line", "level")
    rows = rows.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("end_line", F.lead("start_line").over(w)).withColumn("end_line", F.coalesce("end_line", "n_lines"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("heading_key", canonical_heading(F.col("heading")))
    # the nearest heading of each smaller level; it is an ancestor unless one of a
    # still smaller level came after it, and the last of them is the parent
    own = F.struct("ordinal", "heading", "heading_key")
    nearest = {n: F.last(F.when(F.col("level") == n, own), ignorenulls=True).over(before) for n in range(1, 6)}
    rows = rows.select("*", *[nearest[n].alias(f"_l{n}") for n in nearest])
    above = []
    for n in nearest:
        latest = F.greatest(F.col("_l1.ordinal"), F.lit(-1), *[F.col(f"_l{m}.ordinal") for m in range(2, n + 1)])
        above.append(F.when((F.col("level") > n) & (F.col(f"_l{n}.ordinal") == latest), F.col(f"_l{n}")))
    rows = rows.withColumn("_above", F.filter(F.array(*above), lambda x: x.isNotNull()))
    rows = rows.withColumn("parent", F.get(F.col("_above"), F.size("_above") - 1)["ordinal"])
    rows = rows.withColumn("heading_path", F.concat(F.transform("_above", lambda x: x["heading"]), F.array("heading")))
    rows = rows.withColumn("keys", F.concat(F.transform("_above", lambda x: x["heading_key"]), F.array("heading_key"))).drop("_above", *[f"_l{n}" for n in nearest])
    rows = rows.withColumn("heading_path_key", F.array_join("keys", "/"))
    again = Window.partitionBy(key, "heading_path_key").orderBy("ordinal")
    rows = rows.withColumn("occurrence", F.row_number().over(again).cast("long")).drop("keys", "n_lines")
    return rows.withColumn("id", section_id(F.col(key).cast("string"), F.col("heading_path_key"), F.col("occurrence")))


def section_text(sections_: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """sections with source_text: their lines with their ends, so all sections together are the document."""
    joined = sections_.join(documents.select(key, lines_of(F.col("text")).alias("_lines")), key)
    body = F.slice("_lines", (F.col("start_line") + 1).cast("int"), (F.col("end_line") - F.col("start_line")).cast("int"))
    return joined.withColumn("source_text", F.array_join(body, "")).drop("_lines")


def subtree(sections_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, root, member): descendants are the interval up to the next heading of no greater level."""
    inside = F.sequence(F.col("ordinal") + 1, F.col("stop") - 1)
    rows = sections_.where((F.col("level") > 0) & (F.col("stop") > F.col("ordinal") + 1))
    return rows.select(key, F.col("ordinal").alias("root"), F.explode(inside).alias("member"))


def estimate(text: str) -> int:
    n = len(text.encode())
    return 0 if n == 0 else -(-n // 4) + 2


def _longest(text: str, at: int, budget: int, count) -> int:
    """The end of the longest piece from at within budget, at least one character."""
    low, high = at + 1, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        if count(text[at:mid]) <= budget:
            low = mid
        else:
            high = mid - 1
    return low


def cut_windows(prefix: str, text: str, count=estimate, target: int = TARGET_TOKENS, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows of a section's text.

    A window takes as much as fits the target with its prefix; it ends before a
    fence that opens inside it, else at the last white space of its last part.
    """
    if not text:
        return []
    if prefix and count(prefix) >= target:
        prefix = ""
    full = lambda piece: count(f"{prefix}\n\n{piece}" if prefix else piece)
    out, at = [], 0
    while at < len(text):
        end = _longest(text, at, target, full)
        fenced = False
        if end < len(text):
            opener = [m.start() + 1 for m in re.finditer(r"\n(?= {0,3}(?:```|~~~))", text[at:end])]
            if opener and text[at : at + opener[-1]].strip() and text[at : at + opener[-1]].count("```") % 2 == 0:
                end, fenced = at + opener[-1], True
            else:
                floor = at + int((end - at) * CUT_SHARE)
                gap = max((m.end() for m in re.finditer(r"\s", text[floor:end])), default=0)
                end = floor + gap if gap else end
        if full(text[at:end]) > most:
            end = _longest(text, at, most, full)
        out.append((at, end))
        if end >= len(text):
            break
        start = end
        if not fenced:
            low, high = at + 1, end
            while low < high:  # the longest end of the window within the overlap
                mid = (low + high) // 2
                low, high = (low, mid) if count(text[mid:end]) <= overlap else (mid + 1, high)
            start = low
        at = max(start, at + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def window_spans(prefixes: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in cut_windows(p or "", t or "")] for p, t in zip(prefixes, texts)])


def chunks(sections_with_text: DataFrame) -> DataFrame:
    """Search windows: the section's columns with chunk_ordinal, start, end, chunk, chunk_id, embedding_text."""
    prefix = F.array_join("heading_path", " > ")
    cut = sections_with_text.withColumn("prefix", prefix).select("*", F.posexplode(window_spans("prefix", "source_text")).alias("chunk_ordinal", "w"))
    text = F.substring(F.col("source_text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    out = cut.withColumn("chunk", text).withColumn("start", F.col("w.start")).withColumn("end", F.col("w.end"))
    out = out.withColumn("embedding_text", F.when(F.col("prefix") != "", F.concat("prefix", F.lit("\n\n"), "chunk")).otherwise(F.col("chunk")))
    return out.withColumn("chunk_id", chunk_id(F.col("id"), F.col("chunk_ordinal"), F.col("chunk"))).drop("w", "prefix", "source_text")
