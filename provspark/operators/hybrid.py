"""Greedy span fusion and diversity for a bounded list of hits per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .fusion import BUCKET, RRF_CONSTANT

#: Spans of a section, documents' share of the first pass, token overlap of a near duplicate.
PER_SECTION, PER_DOCUMENT, FIRST_PASS, NEAR = 3, 2, 6, 0.92
#: What a heading equal to the query, terms in the heading (and each of them), and a checkpoint among them add.
HEADING_BOOST, DIRECT_BOOST, TERM_BOOST, CHECKPOINT_BOOST = 4.0, 2.0, 0.1, 10.0
CHANNELS = ("structural", "bm25", "semantic")


def _overlaps(a, b) -> bool:
    return a.section == b.section and a.start < b.end and b.start < a.end


def fuse(hits: pd.DataFrame) -> pd.DataFrame:
    """Merge overlapping spans of one query's channels and add their reciprocal ranks."""
    order = hits.assign(c=hits.channel.map({n: i for i, n in enumerate(CHANNELS)})).sort_values(["c", "rank"], kind="stable")
    spans: list[dict] = []
    for h in order.itertuples(index=False):
        found = next((s for s in spans if _overlaps(s["hit"], h)), None)
        if found is None:
            found = {"hit": h, "score": 0.0, "boost": 0.0, "channels": []}
            spans.append(found)
        elif found["channels"] == ["semantic"] and h.channel != "semantic":
            found["hit"] = h
        found["score"] += 1.0 / (RRF_CONSTANT + h.rank)
        found["boost"] = max(found["boost"], h.boost)  # once a span, whatever its channels
        if h.channel not in found["channels"]:
            found["channels"].append(h.channel)
    rows = [s["hit"]._asdict() | {"score": s["score"] + s["boost"], "channels": ",".join(s["channels"])} for s in spans]
    out = pd.DataFrame(rows)
    out["bucket"] = (out.score / BUCKET).round()
    return out.sort_values(["bucket", "authority", "priority", "score", "path", "section", "start"], ascending=[False, False, False, False, True, True, True], kind="stable")


def _near(a, b) -> bool:
    if a.sha256 == b.sha256 or _overlaps(a, b):
        return True
    if a.section == b.section:
        return False
    x, y = set(a.text.casefold().split()), set(b.text.casefold().split())
    return bool(x | y) and len(x & y) / len(x | y) >= NEAR


def diversify(hits: pd.DataFrame, limit: int) -> pd.DataFrame:
    """First a spread over sections and documents, then what was put off; never near duplicates."""
    rows = list(hits.itertuples(index=False))
    chosen: list = []
    later: list = []

    def offer(h, first: bool) -> None:
        if len(chosen) >= limit:
            return
        if first:
            same_document = sum(c.path == h.path for c in chosen)
            if any(c.section == h.section for c in chosen) or (same_document >= PER_DOCUMENT and len(chosen) < min(limit, FIRST_PASS)):
                later.append(h)
                return
        if sum(c.section == h.section for c in chosen) >= PER_SECTION or any(_near(c, h) for c in chosen):
            return
        chosen.append(h)

    for h in rows:
        offer(h, True)
    for h in list(later):
        offer(h, False)
    return pd.DataFrame(chosen, columns=hits.columns)


def hybrid(hits: DataFrame, limit: int) -> DataFrame:
    """hits(query_id, channel, rank, boost, section, path, start, end, authority, priority, sha256, text).

    Every channel is cut to its own top ranks before, so a query's group is small.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = diversify(fuse(pdf), limit).reset_index(drop=True)
        out["rank"] = range(1, len(out) + 1)
        return out[["query_id", "rank", "section", "path", "start", "end", "score", "channels"]]

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, rank long, section string, path string, start long, end long, score double, channels string")
