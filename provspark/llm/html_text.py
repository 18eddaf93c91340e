"""Main-text extraction from web pages with consensus paths per host.

First pass: every page's containers are scored by the text that stands in them,
widened to the article around them, and vote, with their share of the page's
score, for their generalised tag-class paths.  Spark adds the votes up per host
and path (a host with a third of all pages is pre-aggregated before the shuffle).
Second pass: each page is extracted anew from the nodes on its host's winning
path; a page that has none of its host's winning paths falls back on its own best
container.

Furniture.  Elements such as nav, footer or form never hold main text.  Names in
class, id or role only make an element a suspect: one that turns out to hold the
page's article, or most of its text under a merely compound name, is none.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

#: Elements whose text is never main text.
SKIPPED = frozenset("nav header footer aside form script style noscript template svg iframe object button select option textarea head title menu dialog canvas audio video label input".split())
#: Elements whose content is not markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
#: Words that name furniture of a page.
FURNITURE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|nav\w*|menus?|breadcrumbs?|"
    r"sidebars?|widgets?|rail|related|recommend\w*|trending|share|sharing|social|comments?|disqus|replies|reply|respond|footer|foot|header|masthead|"
    r"pagination|pager|subscribe|newsletter|signup|login|search|toolbar|skip|copyright|legal|metadata|byline|complementary|contentinfo|paywall",
    re.I,
)
#: Of these also compound names are taken at their word.
ALWAYS = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|comments?|disqus|replies|newsletter|subscribe|breadcrumbs?", re.I)
#: Parts that make a name one of a state or layout of the page: no-sidebar, nav-open.
STATES = frozenset("no not non has have with without is are open opened closed close fixed sticky visible invisible hidden shown active inactive enabled disabled on off layout page body html wrapper wrap wide full width theme".split())
#: Words in class or id that mark the article.
ARTICLE = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|post|entry|story|body|text)(?:$|[-_\s])", re.I)
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tfoot tr th caption pre figure figcaption hr address details summary fieldset".split()) | SKIPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open p.
ENDS_P = BLOCKS - {"td", "th", "tr", "caption", "html", "body", "head", "title"}
#: Text of a body's own, as a share of its best container's, from which the body is the article.
BODY_SHARE = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I) for tag in RAW}


@lru_cache(maxsize=100_000)
def suspicion(names: str) -> int:
    """0: no name of furniture; 1: a compound one; 2: a plain one, or one taken at its word."""
    worst = 0
    for name in names.split():
        # side-bar and sideBar are sidebar
        parts = [x for x in re.split(r"[-_:#.\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("side-bar", "sidebar")) if x]
        if not STATES.isdisjoint(parts):
            continue
        if any(FURNITURE.fullmatch(x) for x in parts):
            worst = max(worst, 2 if len(parts) == 1 or any(ALWAYS.fullmatch(x) for x in parts) else 1)
    return worst


class Page:
    """Containers of a page in order, its suspects, and its text blocks."""

    __slots__ = ("parent", "tag", "path", "bonus", "last", "blocks", "suspects", "landmarks")

    def __init__(self) -> None:
        self.parent, self.tag, self.path, self.bonus, self.last = [-1], [""], [""], [1.0], [0]
        self.blocks: list[tuple[int, str, int, int]] = []  # container, text, characters in links, innermost suspect
        self.suspects: list[tuple[int, int]] = []  # the suspect around it, suspicion
        self.landmarks: list[tuple[str, int]] = []  # article, main and h1: tag, innermost suspect

    def settle(self) -> None:
        """Decide about the suspects and leave out the blocks of those that are furniture."""
        if not self.suspects:
            return
        n = len(self.suspects)
        size, holds, total = [0] * n, [False] * n, 0
        for _, text, _, s in self.blocks:
            total += len(text)
            if s >= 0:
                size[s] += len(text)
        articles = [s for t, s in self.landmarks if t != "h1"]
        marks = articles or [s for _, s in self.landmarks]
        if not any(s < 0 for s in marks):
            for s in marks:
                holds[s] = True
        for s in range(n - 1, -1, -1):  # a suspect comes after those around it
            around = self.suspects[s][0]
            if around >= 0:
                size[around] += size[s]
                holds[around] |= holds[s]
        gone = [False] * n
        for s, (around, level) in enumerate(self.suspects):
            innocent = holds[s] or (level == 1 and not marks and 2 * size[s] >= total)
            gone[s] = (around >= 0 and gone[around]) or not innocent
        self.blocks = [b for b in self.blocks if b[3] < 0 or not gone[b[3]]]

    def scores(self) -> list[float]:
        out = [0.0] * len(self.parent)
        for node, text, linked, _ in self.blocks:
            own = max(0, len(text) - 2 * linked)
            out[node] += own
            if self.parent[node] >= 0:
                out[self.parent[node]] += own / 2
        return [s * b for s, b in zip(out, self.bonus)]

    def widen(self) -> list[int]:
        """For each container the one that holds the whole article around it.

        That is the next article or main; without one, the outermost container
        below the body whose further text is not mostly links, or the body where
        much of the text stands directly in it.
        """
        n = len(self.parent)
        direct, whole, linked = [0] * n, [0] * n, [0] * n
        for node, text, in_links, _ in self.blocks:
            direct[node] += len(text) - in_links
            whole[node] += len(text) - in_links
            linked[node] += in_links
        for node in range(n - 1, 0, -1):
            whole[self.parent[node]] += whole[node]
            linked[self.parent[node]] += linked[node]
        out, inside = list(range(n)), [-1] * n
        for node in range(1, n):
            up = self.parent[node]
            inside[node] = node if self.tag[node] in ("article", "main") else inside[up]
        for node in range(1, n):
            if inside[node] >= 0:
                out[node] = inside[node]
                continue
            up = self.parent[node]
            if self.tag[up] in ("", "html") or whole[node] == 0:
                continue
            if self.tag[up] == "body":
                if direct[up] >= BODY_SHARE * whole[node]:
                    out[node] = up
            elif whole[up] - whole[node] >= linked[up] - linked[node]:
                out[node] = out[up]
        return out

    def text(self, nodes: list[int]) -> str:
        out, end = [], -1
        spans = []
        for n in sorted(nodes):
            if n > end:
                spans.append((n, self.last[n]))
                end = self.last[n]
        starts = [a for a, _ in spans]
        for node, text, _, _ in self.blocks:
            at = bisect_right(starts, node) - 1
            if at >= 0 and node <= spans[at][1]:
                out.append(text)
        return "\n\n".join(out)


def _segment(tag: str, classes: str) -> str:
    names = sorted({_DIGITS.sub("#", c.lower()) for c in classes.split()})
    return ".".join([tag, *names])


def parse(source: str) -> Page:
    """One pass over the markup; every step takes a time that doesn't depend on the open elements."""
    page = Page()
    stack: list[tuple[str, int, bool, int]] = []  # tag, container, inside furniture, suspect
    open_tags: dict[str, int] = defaultdict(int)
    block_at: list[int] = []  # places of p and other blocks in the stack
    node, skipped, links, suspect = 0, False, 0, -1
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                page.blocks.append((node, text, min(linked, len(text)), suspect))
        pieces, linked = [], 0

    def pop() -> None:
        nonlocal node, skipped, suspect
        tag, was, hidden, suspected = stack.pop()
        open_tags[tag] -= 1
        if block_at and block_at[-1] == len(stack):
            block_at.pop()
        if was != node:
            page.last[node] = len(page.parent) - 1
        node, skipped, suspect = was, hidden, suspected

    def add(text: str) -> None:
        nonlocal linked
        if text and not skipped:
            pieces.append(text)
            if links:
                linked += len(text)

    at = 0
    size = len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"].replace("&", "&amp;"))
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
            if tag not in VOID and open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                while block_at and stack[block_at[-1]][0] == "p":
                    for _ in range(len(stack) - block_at[-1]):
                        pop()
        elif tag == "br":
            add(" ")
        if tag == "a":
            links += 1
        if tag in VOID:
            continue
        marks = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])} if "=" in m["attrs"] else {}
        named = " ".join(marks.values())
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else size
            continue
        if m["attrs"].endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            block_at.append(len(stack))
        open_tags[tag] += 1
        stack.append((tag, node, skipped, suspect))
        skipped = skipped or tag in SKIPPED
        if skipped:
            continue
        if named and tag in BLOCKS and tag not in ("html", "body", "main") and (level := suspicion(named)):
            page.suspects.append((suspect, level))
            suspect = len(page.suspects) - 1
            if tag == "article":  # a comment or a teaser is no landmark
                tag = "div"
        if tag in ("article", "main", "h1"):
            page.landmarks.append((tag, suspect))
        if tag in CONTAINERS:
            path = page.path[node]
            if len(path) > 160:
                path = "#" + blake2b(path.encode(), digest_size=8).hexdigest()
            page.parent.append(node)
            page.tag.append(tag)
            page.path.append(f"{path}>{_segment(tag, marks.get('class', ''))}")
            page.bonus.append(1.5 if tag in ("article", "main") or (named and ARTICLE.search(named)) else 1.0)
            page.last.append(0)
            node = len(page.parent) - 1
    flush()
    while stack:
        pop()
    page.last[0] = len(page.parent) - 1
    page.settle()
    return page


def votes(page: Page, most: int = 5) -> list[tuple[str, float]]:
    """Paths of the best containers with their shares of the page's score; the shares of the others go to ''."""
    by_path: dict[str, float] = {}
    for wide, score in zip(page.widen(), page.scores()):
        if score > 0:
            path = page.path[wide]
            by_path[path] = by_path.get(path, 0.0) + score
    total = sum(by_path.values())
    ranked = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))
    rest = sum(s for _, s in ranked[most:])
    return [(p, round(s / total, 6)) for p, s in ranked[:most]] + ([("", round(rest / total, 6))] if rest else [])


def extract(page: Page, winners: list[str]) -> tuple[str, str]:
    """Text and path: of the first winning path that is in the page, else its best container, widened."""
    for path in winners:
        nodes = [n for n, p in enumerate(page.path) if p == path]
        if nodes and (text := page.text(nodes)):
            return text, path
    scores = page.scores()
    best = page.widen()[max(range(len(scores)), key=lambda n: (scores[n], -n))]
    same = [n for n, p in enumerate(page.path) if p == page.path[best]]
    return page.text(same), page.path[best]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _vote(batches):
    for whole in batches:
        for batch in slices(whole, "html"):
            hosts, paths, shares = [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, share in votes(parse(source or "")):
                    hosts.append(host)
                    paths.append(path)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])


def _extract(batches):
    for whole in batches:
        for batch in slices(whole, "html"):
            found = [extract(parse(s or ""), w or []) for s, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist())]
            text = pa.array([t for t, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """host, winners: the paths with the most votes of each host, best first.

    A path wins if it has ``least_share`` of its host's votes and at least half
    as many as the best one.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    cast = rows.mapInArrow(_vote, "host string, path string, share double")
    sums = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("n"))
    totals = sums.groupBy("host").agg(F.sum("n").alias("total"), F.max(F.when(F.col("path") != "", F.col("n"))).alias("best"))
    winning = sums.join(totals, "host").where((F.col("path") != "") & (F.col("n") >= least_share * F.col("total")) & (2 * F.col("n") >= F.col("best")))
    return winning.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]).alias("winners"))


def extract_pages(pages: DataFrame, broadcast_hosts: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars, path of every row of pages(page_id, url, html).

    Null or empty html: empty text.  A null or odd url belongs to the host ''.
    Repeated rows give repeated results; other columns are ignored.  The winners
    are broadcast only if there are at most ``broadcast_hosts`` hosts.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    winners = materialize(host_paths(pages), "host-paths")
    side = winners.select(F.col("host").alias("_host"), "winners")
    if winners.count() <= broadcast_hosts:
        side = F.broadcast(side)
    joined = rows.join(side, rows["host"] == side["_host"], "left").select("page_id", "url", "html", "winners")
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return joined.mapInArrow(_extract, f"page_id {id_type}, url {url_type}, text string, n_chars long, path string")
