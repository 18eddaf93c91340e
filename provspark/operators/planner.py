"""Context packs: which sections a task needs, why, and what of them fits the budget.

Searches and graph look-ups are jobs over the whole index; the plan itself is a
bounded list of candidates on the driver, whose order is part of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import markdown, pack
from .filters import FilterSet

#: Candidate categories in order of rank.
CATEGORIES = [
    "direct_requirement", "explicit_dependency", "interface_or_model", "security_constraint", "error_or_failure", "acceptance_or_verify", "decision_constraint",
    "normative_constraint", "testing_constraint", "current_state", "direct_reference", "checkpoint_field", "semantic_fallback",
]
#: Coverage categories that every pack reports, and those that it reports where they apply.
REPORTED = ["PRIMARY", "DEPENDENCIES", "ARCHITECTURE", "SECURITY", "ACCEPTANCE", "VERIFICATION", "CHECKPOINT_DESCENDANTS"]
FURTHER = ["DECISIONS", "CURRENT_STATE", "TESTING", "NORMATIVE"]
#: Fields of a checkpoint in the order in which they give discovery signals.
SIGNAL_FIELDS = "goal why exact_scope dependencies files_modules interfaces_models cli_behavior tests_acceptance_criteria failure_conditions security verify".split()
#: Words that don't make a signal meaningful, or a term of a task.
DISCOVERY_STOP_WORDS = frozenset(
    "about after also before being criteria during exactly from goal implement implementation into must only required requires shall should that their then this through using verify when with without".split()
)
TASK_STOP_WORDS = frozenset("implement using with from".split())
NORMATIVE_WORDS = re.compile(r"(?i)\b(?:must|shall|required|requires|never|only|cannot|ensure|retain|reject|refuse|preserve)\b")
#: What a path or heading says about a discovered section: pattern, coverage, category.
ROLES = [
    (r"\b(?:decision|decisions|adr[-_ ]?\d*|rfc[-_ ]?\d*)\b", "DECISIONS", "decision_constraint"),
    (r"\b(?:progress|current[-_ ]state|delivery[-_ ]state|implementation[-_ ]state|status)\b", "CURRENT_STATE", "current_state"),
    (r"\b(?:architecture|architectural|design|topology|interface|model)\b", "ARCHITECTURE", "interface_or_model"),
    (r"\b(?:security|secure|threat|trust[-_ ]boundary|vulnerability)\b", "SECURITY", "security_constraint"),
    (r"\b(?:acceptance|acceptance[-_ ]criteria)\b", "ACCEPTANCE", "acceptance_or_verify"),
    (r"\b(?:verification|verify|validation)\b", "VERIFICATION", "acceptance_or_verify"),
    (r"\b(?:testing|tests?|quality|qualification|qa)\b", "TESTING", "testing_constraint"),
    (r"\b(?:dependencies|dependency|prerequisite)\b", "DEPENDENCIES", "explicit_dependency"),
]
OPTIONAL = re.compile(r"\b(?:background|rationale|overview|history|historical|appendix|example|research|notes|glossary|archive)\b")
RECOGNIZED = re.compile(r"\b(?:constraint|requirement|contract|policy|rule|mandate)\b")
#: Signals, signals of a query group, characters of a signal and of a probe, hits of a probe.
SIGNALS, GROUP, SIGNAL_CHARS, PROBE_CHARS, PROBE_HITS = 16, 4, 512, 28, 6
#: Semantic scores from which a section matters, alone or by several signals; the same for sections of no recognised role.
MATERIAL, REPEATED, GENERIC, GENERIC_REPEATED = 0.50, 0.42, 0.64, 0.52
NORMATIVE = 4  # authority
GLOBAL_HEADINGS = [
    ("Architecture", "interface_or_model", "ARCHITECTURE"), ("Security", "security_constraint", "SECURITY"), ("Tests", "acceptance_or_verify", "ACCEPTANCE"),
    ("Acceptance", "acceptance_or_verify", "ACCEPTANCE"), ("Verify", "acceptance_or_verify", "VERIFICATION"),
]
EDGES = {"REFERENCES": ("direct_reference", None), "RELATED_SECTION": ("direct_reference", None), "DEPENDS_ON": ("explicit_dependency", "DEPENDENCIES"), "USES_TYPE": ("interface_or_model", "ARCHITECTURE")}


@dataclass
class Candidate:
    """A range of a section, and why it is wanted."""

    section: dict
    start: int
    end: int
    category: str
    reason: str
    relevance: float
    confidence: float
    order: int
    primary: bool = False
    required: bool = False
    coverage: list[str] = field(default_factory=list)

    @property
    def key(self) -> tuple:
        return self.section["id"], self.start, self.end

    @property
    def text(self) -> str:
        return self.section["source_text"][self.start : self.end]

    def sort_key(self) -> tuple:
        s = self.section
        return (not self.primary, not self.required, CATEGORIES.index(self.category), -self.relevance, -s["authority"], -s["priority"], self.order)


class Plan:
    """Candidates by range; a range that is wanted twice keeps the stronger category and both reasons."""

    def __init__(self, filters: FilterSet) -> None:
        self.filters, self.candidates, self.added = filters, {}, 0
        self.ambiguous: list[dict] = []
        self.unresolved: list[dict] = []

    def admits(self, s: dict) -> bool:
        """The document filters once more; heading and scope don't bind graph evidence."""
        f = self.filters
        return (
            (not f.documents or s["path"] in f.documents or s["doc_id"] in f.documents) and s["path"] not in f.exclude_documents
            and (f.authority_floor is None or s["authority"] >= f.authority_floor) and (not f.authorities or s["authority"] in f.authorities)
        )

    def add(self, section: dict, category: str, reason: str, relevance: float, confidence: float, coverage=(), primary=False, required=False, span=None) -> bool:
        if not self.admits(section):
            return False
        start, end = span or (0, len(section["source_text"]))
        new = Candidate(section, start, end, category, reason, relevance, confidence, self.added, primary, required, list(coverage))
        self.added += 1
        old = self.candidates.get(new.key)
        if old:
            stronger = (new.primary and not old.primary) or CATEGORIES.index(new.category) < CATEGORIES.index(old.category)
            first, second = (new, old) if stronger else (old, new)
            first.required, first.primary = first.required or second.required, first.primary or second.primary
            first.coverage = list(dict.fromkeys([*old.coverage, *new.coverage]))
            if second.reason not in first.reason:
                first.reason += f"; {second.reason}"
            new = first
        self.candidates[new.key] = new
        return True

    def ordered(self) -> list[Candidate]:
        return sorted(self.candidates.values(), key=Candidate.sort_key)


def meaningful(text: str) -> set[str]:
    return {t.casefold() for t in re.findall(r"[A-Za-z][A-Za-z0-9_.@/-]{3,}", text)} - DISCOVERY_STOP_WORDS


def bounded(text: str) -> str:
    return " ".join(text.split())[:SIGNAL_CHARS].rstrip()


def discovery_signals(task: str, checkpoints: list[dict]) -> list[tuple[str, str]]:
    """(signal, origin): the task, then titles, fields and normative lines of its checkpoints; the first sixteen distinct ones."""
    offered = [(task, "task")]
    for c in checkpoints:
        offered.append((c["title"], "checkpoint_title"))
        offered += [(v, f) for f in SIGNAL_FIELDS for v in c["fields"].get(f, ())]
        for s in c["sections"]:
            bare = (re.sub(r"^[#>*+\-\d.()\s]+", "", line).strip(" `") for line in re.split(r"\r\n|\r|\n", s["source_text"]))
            offered += [(line, "normative_requirement") for line in bare if NORMATIVE_WORDS.search(line)]
    out: dict[str, tuple[str, str]] = {}
    for text, origin in offered:
        if meaningful(signal := bounded(text)):
            out.setdefault(signal.casefold(), (signal, origin))
    return list(out.values())[:SIGNALS]


def role(section: dict) -> tuple[str, str, bool, bool]:
    """Coverage, category, whether the role is recognised, whether the section is optional."""
    heading = " ".join(section["heading_path"]).casefold()
    label = f"{section['path'].casefold()} {heading}"
    optional = bool(OPTIONAL.search(label))
    for pattern, coverage, category in ROLES:
        if re.search(pattern, label):
            return coverage, category, True, optional
    return "NORMATIVE", "normative_constraint", bool(RECOGNIZED.search(heading)), optional


def is_material(optional: bool, recognized: bool, overlap: int, score: float, signals: int) -> bool:
    if optional:
        return score >= MATERIAL or overlap > 0
    if recognized and (score >= MATERIAL or (score >= REPEATED and signals >= 2) or overlap):
        return True
    return overlap >= 2 or score >= GENERIC or (score >= GENERIC_REPEATED and signals >= 2)


def _sections(engine, ids, column: str = "id") -> dict[str, dict]:
    rows = engine.store.table("sections").where(F.col(column).isin(list(ids))).collect()
    return {r["id"]: r.asDict(recursive=True) for r in rows}


def _checkpoint(engine, name: str, document: str | None) -> dict | None:
    """A checkpoint with its sections, the root first."""
    row = engine.checkpoint(name, document).first()
    if row is None:
        return None
    own = engine.store.table("sections").where(F.col("doc_id") == row["doc_id"])
    root = own.where(F.col("ordinal") == row["root"])
    inside = markdown.subtree(root).select("doc_id", F.col("member").alias("ordinal"))
    members = own.join(inside.unionByName(root.select("doc_id", "ordinal")), ["doc_id", "ordinal"]).orderBy("ordinal").collect()
    return row.asDict(recursive=True) | {"sections": [m.asDict(recursive=True) for m in members]}


def child_role(heading_key: str) -> tuple[str, list[str]]:
    """Category and coverage of a section below a requested checkpoint, by its heading."""
    below = "CHECKPOINT_DESCENDANTS"
    has = lambda *words: any(w in heading_key for w in words)
    if has("depend"):
        return "explicit_dependency", [below, "DEPENDENCIES"]
    if has("interface", "model", "architect"):
        return "interface_or_model", [below, "ARCHITECTURE"]
    if has("security"):
        return "security_constraint", [below, "SECURITY"]
    if has("verify"):
        return "acceptance_or_verify", [below, "VERIFICATION"]
    if has("test", "accept"):
        return "acceptance_or_verify", [below, "ACCEPTANCE"]
    return ("error_or_failure" if has("failure", "error") else "checkpoint_field"), [below]


def strict_discovery(engine, task: str, checkpoints: list[dict], excluded: set[str]) -> list[dict]:
    """Normative sections of other documents that the signals of a task find and that matter for it.

    The signals, four to a query, are one table of queries; a short probe of all
    signals ranks the sections of every document for itself, so that no document
    hides another.
    """
    signals = discovery_signals(task, checkpoints)
    if not signals:
        return []
    groups = [bounded(" ".join(s for s, _ in signals[n : n + GROUP])) for n in range(0, len(signals), GROUP)]
    origins = {q: {o for _, o in signals[n * GROUP : (n + 1) * GROUP]} for n, q in enumerate(groups)}
    probe = bounded(" ".join(s[:PROBE_CHARS] for s, _ in signals))
    origins[probe] = {o for _, o in signals}
    floor, depth = FilterSet(authority_floor=NORMATIVE), engine._limit(1 << 30)
    queries = engine.spark.createDataFrame(list(enumerate(groups)), "query_id long, query string")
    near = engine.search_semantic(queries, depth, floor).select("query_id", F.col("id").alias("section"), "rank", "score", F.lit("semantic").alias("channels"))
    fused = engine.search(queries, depth, floor, require_semantic=True).select("query_id", "section", "rank", F.lit(-1.0).alias("score"), "channels")
    one = engine.spark.createDataFrame([(len(groups), probe)], "query_id long, query string")
    probed = engine.search_semantic(one, 1 << 30, floor)
    by_path = F.row_number().over(Window.partitionBy("path").orderBy("rank"))
    probed = probed.withColumn("rank", by_path.cast("long")).where(F.col("rank") <= PROBE_HITS).select("query_id", F.col("id").alias("section"), "rank", "score", F.lit("semantic").alias("channels"))
    hits = fused.unionByName(near).unionByName(probed)
    gathered = hits.groupBy("section").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.collect_set("query_id").alias("queries"), F.collect_set("channels").alias("channels")).collect()
    texts, names = _sections(engine, [g["section"] for g in gathered if g["section"] not in excluded]), [*groups, probe]
    out = []
    for g in gathered:
        if g["section"] not in texts:
            continue
        section = texts[g["section"]]
        asked = [names[i] for i in sorted(g["queries"])]
        overlap = meaningful(section["source_text"]) & set().union(*(meaningful(a) for a in asked))
        coverage, category, recognized, optional = role(section)
        if is_material(optional, recognized, len(overlap), g["score"], len(asked)):
            channels = sorted({c for x in g["channels"] for c in x.split(",")})
            found = set().union(*(origins[a] for a in asked))
            out.append({"section": section, "coverage": coverage, "category": category, "optional": optional, "rank": g["rank"], "score": g["score"], "queries": asked, "origins": sorted(found), "channels": channels, "overlap": sorted(overlap)})
    place = {c: n for n, c in enumerate([*REPORTED, *FURTHER])}
    key = lambda d: (d["optional"], place[d["coverage"]], -len(d["queries"]), d["rank"], -len(d["overlap"]), d["section"]["path"], d["section"]["start_line"], d["section"]["id"])
    return sorted(out, key=key)


def discovery_confidence(d: dict) -> float:
    near = 0.08 * max(0.0, min(d["score"], 1.0)) + (0.08 if d["rank"] <= 3 else 0.0)
    return min(0.99, 0.68 + 0.04 * min(len(d["queries"]), 4) + 0.03 * min(len(d["overlap"]), 3) + near)


def _omission(category: str, reason: str, s: dict) -> dict:
    return {"category": category, "reason": reason, "section": s["id"], "path": s["path"], "start_line": s["start_line"], "end_line": s["end_line"]}


def _follow(engine, plan: Plan, seeds: list[str], relevance: float, names: list[str]) -> list[str]:
    """Add what the edges of some sections lead to; returns the sections' children."""
    if not seeds:
        return []
    edges = engine.store.table("edges").where(F.col("source").isin(seeds) & F.col("edge_type").isin([*EDGES, "PARENT_OF"])).collect()
    known = _sections(engine, {t for e in edges for t in e["targets"].split(",") if t} | set(seeds))
    children = [e["targets"] for e in edges if e["edge_type"] == "PARENT_OF"]
    order = {s: n for n, s in enumerate(seeds)}
    for e in sorted(edges, key=lambda e: (order[e["source"]], e["edge_type"], e["label"])):
        if e["edge_type"] not in EDGES:
            continue
        category, coverage = EDGES[e["edge_type"]]
        required, source = bool(names and coverage), known[e["source"]]
        if e["status"] == "RESOLVED":
            target = known[e["targets"]]
            taken = plan.add(target, category, f"{e['edge_type']}: {e['label']}", relevance, 1.0, [coverage] if coverage else [], required=required)
            if required and not taken:
                plan.unresolved.append(_omission(coverage, "required target is excluded by the filters", target))
        elif required and e["status"] == "AMBIGUOUS":
            candidates = [{"section": t, "path": known[t]["path"]} for t in e["targets"].split(",") if t in known]
            plan.ambiguous.append({"category": coverage, "label": e["label"], "source": source["id"], "candidates": candidates})
        elif required:
            plan.unresolved.append(_omission(coverage, f"unresolved: {e['label']}", source))
    return children


def _hits(engine, plan: Plan, query: str, limit: int, filters: FilterSet, require_semantic: bool) -> list[tuple[dict, dict]]:
    rows = engine.search(query, limit, filters, require_semantic).orderBy("rank").collect()
    known = _sections(engine, {r["section"] for r in rows})
    return [(r.asDict(), known[r["section"]]) for r in rows if r["section"] in known]


def plan_pack(engine, task: str, filters: FilterSet, strict: bool, require_semantic: bool, document: str | None) -> tuple[Plan, list[str]]:
    plan = Plan(filters)
    names = list(dict.fromkeys(x.upper() for x in re.findall(P.QUERY_CLASSES["checkpoint_ids"], task)))
    if document is None and len(filters.documents) == 1:
        document = next(iter(filters.documents))
    checkpoints = [c for c in (_checkpoint(engine, n, document) for n in names) if c]
    for c in checkpoints:
        root, *below = c["sections"]
        plan.add(root, "direct_requirement", f"requested checkpoint {c['checkpoint_id']}", 100.0, 1.0, ["PRIMARY"], primary=True, required=True)
        for s in below:
            category, coverage = child_role(s["heading_key"])
            plan.add(s, category, f"part of requested {c['checkpoint_id']}", 50.0, 1.0, coverage, required=True)
    names = [c["checkpoint_id"] for c in checkpoints]
    own = {s["id"] for c in checkpoints for s in c["sections"]}
    direct = _hits(engine, plan, task, 12, filters, require_semantic)
    open_terms = {t.casefold() for t in re.findall(r"[\w.@/:-]+", task) if len(t) > 2} - TASK_STOP_WORDS
    for n, (hit, section) in enumerate(direct, 1):
        if strict and names and section["id"] not in own:
            continue
        span = (hit["start"], hit["end"])
        folded = section["source_text"][slice(*span)].casefold()
        covered = {t for t in open_terms if t in folded}
        required = not names and (n == 1 or bool(covered))
        if required:
            open_terms -= covered
        plan.add(section, "semantic_fallback" if names else "direct_requirement", f"search rank {n} by {hit['channels']}", hit["score"], max(0.5, 1.0 - n * 0.04), [] if names else ["PRIMARY"], required=required, span=span)
    seeds = [c["sections"][0]["id"] for c in checkpoints] or list(dict.fromkeys(s["id"] for _, s in direct[:4]))
    children = _follow(engine, plan, seeds, 25.0, names)
    _follow(engine, plan, children, 20.0, names)
    if names:
        _global_headings(engine, plan, filters)
    if strict:
        for d in strict_discovery(engine, task, checkpoints, own):
            reason = f"strict discovery; signals {','.join(d['origins'])}; channels {','.join(d['channels'])}; score {d['score']:.4f}; rank {d['rank']}"
            relevance = 10.0 * len(d["queries"]) + len(d["overlap"]) - d["rank"] / 100
            taken = plan.add(d["section"], d["category"], reason, relevance, discovery_confidence(d), [d["coverage"]], required=not d["optional"])
            if not taken and not d["optional"]:
                plan.unresolved.append(_omission(d["coverage"], f"excluded by the filters; {reason}", d["section"]))
    _fallbacks(engine, plan, task, filters, require_semantic)
    return plan, names


def _global_headings(engine, plan: Plan, filters: FilterSet) -> None:
    """Normative sections under a heading of a category that the checkpoint itself doesn't cover."""
    covered = {c for x in plan.candidates.values() for c in x.coverage}
    wanted = [(n, *g) for n, g in enumerate(GLOBAL_HEADINGS) if g[2] not in covered]
    if not wanted:
        return
    queries = engine.spark.createDataFrame([(n, heading) for n, heading, _, _ in wanted], "query_id long, query string")
    rows = engine.search_exact(queries, 3, replace(filters, authority_floor=NORMATIVE)).orderBy("query_id", "rank").collect()
    by_query = {n: (heading.casefold(), category, coverage) for n, heading, category, coverage in wanted}
    for r in rows:
        heading, category, coverage = by_query[r["query_id"]]
        if heading in r["heading_key"]:
            plan.add(r.asDict(recursive=True), category, f"global normative heading {heading}", 15.0, 1.0, [coverage], required=True)


def _fallbacks(engine, plan: Plan, task: str, filters: FilterSet, require_semantic: bool) -> None:
    folded, wanted = task.casefold(), []
    if len(plan.candidates) < 3:
        wanted.append((task, "semantic_fallback", "little explicit evidence", None))
    if "security" in folded:
        wanted.append(("security", "security_constraint", "the task asks for security", "SECURITY"))
    if any(w in folded for w in ("error", "failure", "timeout", "exception")):
        wanted.append((task, "error_or_failure", "the task names failures", None))
    if any(w in folded for w in ("test", "acceptance", "verify")):
        wanted.append((task, "acceptance_or_verify", "the task asks for acceptance", "ACCEPTANCE"))
    for query, category, reason, coverage in wanted:
        for n, (hit, section) in enumerate(_hits(engine, plan, query, 3, filters, require_semantic), 1):
            plan.add(section, category, f"{reason}; rank {n}", hit["score"], 0.6, [coverage] if coverage else [], required=coverage is not None, span=(hit["start"], hit["end"]))


def coverage_of(plan: Plan, selected: set[tuple], conflicts: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """The pack's status, a row per coverage category, and what is missing of the required evidence."""
    every = plan.ordered()
    missing = [c for c in every if c.required and c.key not in selected]
    omissions = [*plan.unresolved, *(_omission((c.coverage or ["PRIMARY"])[-1], f"did not fit the budget; {c.reason}", c.section) for c in missing)]
    conflicting = {x for c in conflicts for x in (c["left_item"], c["right_item"])}
    applicable = {x for c in every for x in c.coverage} | {u["category"] for u in plan.unresolved} | {a["category"] for a in plan.ambiguous}
    rows = []
    for name in [*REPORTED, *(f for f in FURTHER if f in applicable)]:
        own = [c for c in every if name in c.coverage]
        gone = [c for c in missing if name in c.coverage]
        open_ones = [u for u in plan.unresolved if u["category"] == name]
        unsure = [a for a in plan.ambiguous if a["category"] == name]
        evidence = [c.section["id"] for c in own if c.key in selected]
        if unsure:
            status = "AMBIGUOUS"
        elif gone or open_ones:
            status = "OMITTED"
        elif conflicting & set(evidence):
            status = "CONFLICTING"
        else:
            status = "COVERED" if own else "NOT_APPLICABLE"
        rows.append({"category": name, "status": status, "required": any(c.required for c in own) or bool(open_ones or unsure), "evidence": evidence, "omitted": len(gone) + len(open_ones)})
    if conflicts:
        return "CONFLICTING", rows, omissions
    if plan.ambiguous:
        return "AMBIGUOUS", rows, omissions
    if omissions:
        return "PARTIAL", rows, omissions
    return ("COMPLETE" if any(r["status"] == "COVERED" for r in rows) else "NOT_APPLICABLE"), rows, omissions


def match_excerpt(text: str, task: str, size: int = 600) -> str:
    """The part of a text around the first of the task's terms that it holds, cut at line ends."""
    folded = text.casefold()
    places = [folded.find(t) for t in sorted(meaningful(task), key=lambda t: (-len(t), t))]
    at = next((p for p in places if p >= 0), 0)
    start = text.rfind("\n", 0, max(0, at - size // 3)) + 1
    end = text.find("\n", min(len(text), start + size))
    return text[start : len(text) if end < 0 else end]


def _shown(c: Candidate) -> dict:
    s = c.section
    return {"category": c.category, "reason": c.reason, "confidence": round(c.confidence, 4), "path": s["path"], "start_line": s["start_line"], "end_line": s["end_line"]}


def context_pack(engine, task: str, budget: int, filters: FilterSet, strict: bool, require_semantic: bool, document: str | None) -> dict:
    if strict or require_semantic:
        engine.require_semantic_ready()
    generation = engine.store.generation()
    plan, names = plan_pack(engine, task, filters, strict, require_semantic or strict, document)
    ordered = plan.ordered()
    offers, by_id = [], {}
    for n, c in enumerate(ordered):
        label = c.section["id"] if (c.start, c.end) == (0, len(c.section["source_text"])) else f"{c.section['id']}@{c.start}-{c.end}"
        by_id[label] = c
        offers.append({"id": label, "text": c.text, "excerpt": match_excerpt(c.text, task), "required": c.required, "primary": c.primary and n == 0, "extra": _shown(c)})
    packed = pack.fill(offers, budget)
    chosen = [by_id[i["id"]] for i in packed.items]
    said = engine.spark.createDataFrame([(c.section["id"], c.section["heading"], c.text) for c in chosen], "item string, heading string, source_text string")
    conflicts = [r.asDict() for r in pack.conflicts(said).collect()] if chosen else []
    status, coverage, omissions = coverage_of(plan, {c.key for c in chosen}, conflicts)
    if packed.tokens > budget or engine.store.generation() != generation:
        raise RuntimeError("the index changed while the pack was planned, or the pack exceeds its budget")
    return {"status": status, "items": packed.items, "omitted": packed.omitted, "tokens": packed.tokens, "coverage": coverage, "omissions": omissions, "ambiguous": plan.ambiguous, "conflicts": conflicts, "checkpoints": names, "generation": generation}


def checkpoint_context(engine, name: str, document: str | None, budget: int, strict: bool) -> dict:
    c = _checkpoint(engine, name, document)
    if c is None:
        raise ValueError(f"no such checkpoint: {name}")
    ids = [s["id"] for s in c["sections"]]
    edges = [e.asDict() for e in engine.store.table("edges").where(F.col("source").isin(ids)).orderBy("edge_type", "label", "source").collect()]
    targets = _sections(engine, {e["targets"] for e in edges if e["status"] == "RESOLVED"})
    interfaces, security = {}, {}
    for e in edges:
        t = targets.get(e["targets"])
        if t is None:
            continue
        if e["edge_type"] == "USES_TYPE" or (e["edge_type"] == "DEPENDS_ON" and re.search(r"(?i)\b(?:interface|model|type|class)\b", t["source_text"])):
            interfaces[t["id"]] = t["heading"]
        if "security" in t["source_text"].casefold():
            security[t["id"]] = {"path": t["path"], "applicability": "directly_applicable", "reason": f"{e['edge_type']}: {e['label']}"}
    text = "\n".join(s["source_text"] for s in c["sections"])
    errors = sorted({m[0] for k in ("error", "constant") for m in re.finditer(P.SYMBOLS[k], text)})
    for floor, documents, limit, applicability in ((3, frozenset({c["doc_id"]}), 10, "global"), (NORMATIVE, frozenset(), 3, "semantic_candidate")):
        if applicability == "semantic_candidate" and security:
            break
        for hit, s in _hits(engine, Plan(FilterSet()), "security", limit, FilterSet(documents=documents, authority_floor=floor), strict):
            if applicability == "semantic_candidate" or "security" in s["source_text"][hit["start"] : hit["end"]].casefold():
                security.setdefault(s["id"], {"path": s["path"], "applicability": applicability, "reason": "search for security"})
    packed = engine.context_pack(f"Implement {c['checkpoint_id']} - {c['title']}", budget, strict=strict, document=c["doc_id"])
    fields = c["fields"]
    return {
        "checkpoint_id": c["checkpoint_id"], "title": c["title"], "document": c["doc_id"], "sections": ids, "fields": fields, "interfaces": interfaces, "errors": errors, "security": security,
        "dependencies": [e for e in edges if e["edge_type"] == "DEPENDS_ON"], "references": [e for e in edges if e["edge_type"] in ("REFERENCES", "RELATED_SECTION")],
        "acceptance": fields.get("tests_acceptance_criteria", []), "verify": fields.get("verify", []), "out_of_scope": fields.get("out_of_scope", []), "context_pack": packed,
    }
