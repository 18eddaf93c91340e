"""The engine: a workspace of Markdown documents, indexed in generations and searched."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.classify import structural_terms
from .functions.embed import HashEmbedding, embedder
from .functions.text import ascii_lower, canonical_heading
from .operators import graph, hybrid, identity, lexical, markdown, pack, planner, semantic, structural
from .operators.filters import FilterSet
from .plans.snapshot import Store
from .sources import workspace as W

#: Raised when a rule changes; an index of other versions is stale, and built anew by the next sync.
VERSIONS = {"parser_version": "2", "chunker_version": "1", "heading_version": "1", "graph_version": "2", "checkpoint_version": "1", "retrieval_version": "2", "embedding_text_version": "1"}
#: The status category of each version.
STALE = {"parser_version": "PARSER_STALE", "chunker_version": "PARSER_STALE", "heading_version": "PARSER_STALE", "graph_version": "GRAPH_STALE", "checkpoint_version": "GRAPH_STALE", "retrieval_version": "SCHEMA_STALE", "embedding_text_version": "EMBEDDINGS_STALE"}
_OF_DOCUMENT = ["path", "authority", "priority", "sha256"]


class StaleIndex(RuntimeError):
    """A source file differs from what is indexed."""


class SemanticUnavailable(RuntimeError):
    """Semantic search was required and can't be had; ``reason`` says why."""

    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


def open_engine(spark: SparkSession, root: str | Path, make=HashEmbedding, require_semantic: bool = False) -> Engine:
    """An engine with the provider that ``make`` gives; without one, lexical only unless semantic search is required."""
    try:
        make()
    except Exception as failure:  # noqa: BLE001  a provider may fail in any way
        if require_semantic:
            raise SemanticUnavailable("PROVIDER_UNAVAILABLE", str(failure)) from failure
        return Engine(spark, root, None)
    return Engine(spark, root, make)


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path, provider=HashEmbedding) -> None:
        self.spark, self.root, self.provider = spark, Path(root), provider
        self.store = Store(spark, root)

    @property
    def provider_identity(self) -> str:
        return self.provider().identity if self.provider else "none"

    # configuration
    def init(self) -> None:
        W.initialize(self.root)

    def add(self, path: str, authority: int = 3, priority: int = 0) -> None:
        W.save(self.root, W.load(self.root).with_document(W.Document(path, authority, priority)))

    def remove(self, path: str) -> None:
        W.save(self.root, W.load(self.root).without_document(path))

    def rename(self, path: str, new: str) -> None:
        """Configure a moved document; with the same text it keeps its id at the next sync."""
        workspace = W.load(self.root)
        old = next((d for d in workspace.documents if d.path == W.normalize_path(path)), None)
        if old is None:
            raise W.ConfigError(f"not configured: {path}")
        W.save(self.root, workspace.without_document(path).with_document(replace(old, path=new)))

    # indexing
    def _fingerprint(self, sources: DataFrame) -> str:
        """Changes with any source, its rank, the provider or a version."""
        parts = [str(x) for x in identity.fingerprint(sources).first()] + [self.provider_identity, json.dumps(VERSIONS, sort_keys=True)]
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    def sync(self) -> dict:
        """Index what changed as a new generation; no work if nothing did.

        Sections, windows and vectors of unchanged (also renamed) documents are
        carried over; only windows without a vector of this provider are embedded.
        """
        workspace = W.load(self.root)
        sources = W.read_sources(self.spark, self.root, workspace).persist()
        try:
            generation = self.store.generation()
            mark = self._fingerprint(sources)
            manifest = self.store.manifest()
            if generation and manifest.get("fingerprint") == mark:
                return {"index_generation": generation, "documents_unchanged": len(workspace.documents)}
            usable = bool(generation) and self.store.usable() and manifest.get("versions") == VERSIONS
            return self._index(sources, generation, manifest if usable else {}, mark)
        finally:
            sources.unpersist()

    def _index(self, sources: DataFrame, generation: int, manifest: dict, mark: str) -> dict:
        writer = self.store.writer(generation)
        before = lambda name: self.store.table(name, generation) if manifest else None
        known = before("documents") if manifest else sources.limit(0).withColumn("doc_id", F.lit(""))
        plan = identity.plan_identity(known, sources)
        found = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
        named = identity.with_ids(plan, known, uuid.uuid4().hex)
        documents = writer.write("documents", sources.join(named, "path").select("doc_id", *_OF_DOCUMENT, "status"))
        rank = documents.select("doc_id", *_OF_DOCUMENT)
        texts = sources.select("path", "text").join(documents.where("status in ('added', 'changed')").select("path", "doc_id"), "path").drop("path")
        parsed = markdown.section_text(markdown.sections(texts), texts).withColumn("source_sha", F.sha2("source_text", 256))
        kept = documents.where("status in ('unchanged', 'renamed')").select("doc_id")
        carry = lambda rows: rows.drop(*_OF_DOCUMENT).join(kept, "doc_id", "left_semi")
        sections = parsed.unionByName(carry(before("sections"))) if manifest else parsed
        sections = writer.write("sections", sections.join(rank, "doc_id"))
        cut = markdown.chunks(sections.join(texts.select("doc_id"), "doc_id", "left_semi").drop(*_OF_DOCUMENT, "source_sha"))
        cut = cut.withColumn("source_sha", F.sha2("chunk", 256)).withColumn("embedding_sha", F.sha2("embedding_text", 256))
        old = before("chunks")
        same_provider = bool(manifest) and manifest.get("provider") == self.provider_identity
        none = F.lit(None).cast("array<float>")
        pool = old.dropDuplicates(["chunk_id"]) if same_provider else None
        cut = identity.reuse_vectors(cut, pool) if pool is not None else cut.withColumn("vector", none)
        if manifest:
            cut = cut.unionByName(carry(old) if same_provider else carry(old).withColumn("vector", none))
        ready = writer.write("kept_chunks", cut)
        missing = ready.where("vector is null")
        created = missing.count() if self.provider else 0
        if self.provider:
            # rows that have a vector never reach the provider
            made = missing.withColumn("vector", embedder(self.provider)("embedding_text"))
            ready = ready.where("vector is not null").unionByName(made)
        chunks = writer.write("chunks", ready.join(rank, "doc_id"))
        writer.write("edges", self._edges(sections))
        writer.write("symbols", graph.symbols(sections))
        writer.write("checkpoints", pack.checkpoints(sections))
        counters = {f"documents_{k}": found.get(k, 0) for k in ("added", "changed", "unchanged", "removed", "renamed")}
        for name, rows, key in (("sections", sections, "id"), ("chunks", chunks, "chunk_id")):
            earlier = before(name) if manifest else rows.limit(0)
            diff = identity.diff_rows(earlier.dropDuplicates([key]), rows.dropDuplicates([key]), [key], "source_sha").first()
            counters |= {f"{name}_{k}": diff[k] for k in ("added", "changed", "unchanged", "removed")}
        counters |= {"embeddings_created": created, "embeddings_retained": chunks.count() - created if self.provider else 0}
        dimensions = self.provider().dimensions if self.provider else 0
        n = writer.commit({"fingerprint": mark, "provider": self.provider_identity, "dimensions": dimensions, "versions": VERSIONS, "counters": counters})
        return counters | {"index_generation": n}

    @staticmethod
    def _edges(sections: DataFrame) -> DataFrame:
        resolved = graph.resolve(graph.mentions(sections), graph.declarations(sections))
        parents = graph.parent_edges(sections).select("source", "edge_type", "label", F.lit("RESOLVED").alias("status"), F.col("target").alias("targets"))
        return resolved.unionByName(parents)

    def generation_log(self) -> DataFrame:
        return self.store.log()

    def _present(self) -> tuple[W.Workspace, list[tuple[str, str]]]:
        """The configured documents that can be read, and why the others can't."""
        workspace, missing, there = W.load(self.root), [], []
        for d in workspace.documents:
            try:
                W.safe_source(self.root, d.path, workspace.max_file_bytes)
                there.append(d)
            except (W.ConfigError, OSError) as error:
                missing.append((d.path, str(error)))
        return replace(workspace, documents=tuple(there)), missing

    def status(self, path: str | None = None) -> DataFrame:
        """path, status of all documents, or of one."""
        present, missing = self._present()
        if path is not None:
            present = replace(present, documents=tuple(d for d in present.documents if d.path == path))
            missing = [m for m in missing if m[0] == path]
        sources = W.read_sources(self.spark, self.root, present).select("path", "sha256")
        absent = self.spark.createDataFrame([(p, None) for p, _ in missing], "path string, sha256 string")
        indexed = self.store.table("documents").select("path", "sha256") if self.store.generation() and self.store.usable() else sources.limit(0)
        if path is not None:
            indexed = indexed.where(F.col("path") == path)
        return identity.freshness(sources.unionByName(absent), indexed)

    def report(self) -> dict:
        """The index's category (the first reason's), all reasons, generation and channels."""
        present, missing = self._present()
        reasons = [("MISSING_SOURCE", p, why) for p, why in missing]
        manifest = self.store.manifest()
        if manifest and not self.store.usable():
            reasons.append(("SCHEMA_STALE", None, "the index has an older schema"))
        elif manifest:
            now = W.read_sources(self.spark, self.root, present).select(*_OF_DOCUMENT)
            then = self.store.table("documents").select("path", *[F.col(c).alias(f"_{c}") for c in _OF_DOCUMENT[1:]])
            category = (
                F.when(F.col("_sha256").isNull(), "METADATA_STALE").when(F.col("sha256") != F.col("_sha256"), "SOURCE_STALE")
                .when((F.col("authority") != F.col("_authority")) | (F.col("priority") != F.col("_priority")), "METADATA_STALE")
            )
            differing = now.join(then, "path", "left").withColumn("category", category).where("category is not null").orderBy("path")
            reasons += [(r["category"], r["path"], "differs from the committed generation, or isn't in it") for r in differing.select("category", "path").collect()]
            gone = then.join(now, "path", "left_anti").where(~F.col("path").isin([p for p, _ in missing]))
            reasons += [("METADATA_STALE", r["path"], "indexed, but no longer configured") for r in gone.orderBy("path").select("path").collect()]
            indexed = manifest.get("versions", {})
            reasons += [(STALE[k], None, f"{k}: indexed {indexed.get(k)}, known {v}") for k, v in VERSIONS.items() if indexed.get(k) != v]
        elif present.documents:
            reasons += [("METADATA_STALE", d.path, "configured document is not indexed") for d in present.documents]
        channels = ["structural", "lexical"]
        if self.provider and manifest:
            try:
                self.require_semantic_ready()
                channels.append("semantic")
            except SemanticUnavailable as error:
                reasons.append(("EMBEDDINGS_STALE", None, str(error)))
        return {
            "category": reasons[0][0] if reasons else "CLEAN", "reasons": [{"category": c, "path": p, "reason": r} for c, p, r in reasons], "generation": self.store.generation(),
            "provider": manifest.get("provider", "none"), "channels": channels, "mode": "HYBRID" if "semantic" in channels else "LEXICAL_ONLY", "versions": VERSIONS,
        }

    def require_semantic_ready(self) -> None:
        """Raise a typed reason unless every window has a sound vector of this provider."""
        if not self.provider:
            raise SemanticUnavailable("PROVIDER_UNAVAILABLE", "no embedding provider")
        manifest = self.store.manifest()
        if manifest.get("provider") != self.provider_identity or manifest.get("dimensions") != self.provider().dimensions:
            raise SemanticUnavailable("IDENTITY_MISMATCH", f"indexed {manifest.get('provider')}, provider {self.provider_identity}")
        for key in ("chunker_version", "embedding_text_version"):
            if manifest["versions"].get(key) != VERSIONS[key]:
                raise SemanticUnavailable("VECTOR_INDEX_STALE", key)
        chunks = self.store.table("chunks")
        vectors = chunks.where("vector is not null").select("chunk_id", "source_sha", "vector")
        n = identity.audit_vectors(chunks.select("chunk_id", "source_sha"), vectors, manifest["dimensions"]).first()
        if n["missing"] or not sum(n):
            raise SemanticUnavailable("VECTOR_INDEX_MISSING", f"{n['missing']} windows without a vector")
        if n["stale"]:
            raise SemanticUnavailable("VECTOR_INDEX_STALE", f"{n['stale']} vectors")
        if n["wrong_size"] or n["not_finite"]:
            raise SemanticUnavailable("VECTOR_INDEX_CORRUPT", f"{n['wrong_size']} of wrong size, {n['not_finite']} not finite")

    def _fresh(self, path: str) -> None:
        if not self.status(path).where("status <> 'FRESH'").isEmpty():
            raise StaleIndex(f"{path}: run sync")

    # searching: every call also takes a whole table of queries (query_id, query)
    def _queries(self, query) -> DataFrame:
        """Blank queries find nothing."""
        if not isinstance(query, DataFrame):
            query = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return query.where(F.trim("query") != "")

    def _limit(self, limit: int) -> int:
        return max(1, min(limit, W.load(self.root).max_results))

    def _chunks(self, filters: FilterSet) -> DataFrame:
        return filters.apply(self.store.table("chunks"))

    def search_exact(self, query, limit: int = 10, filters: FilterSet = FilterSet()) -> DataFrame:
        q, limit = self._queries(query), self._limit(limit)
        terms = q.select("query_id", F.explode(F.array_distinct(F.concat(F.array("query"), structural_terms(F.col("query"))))).alias("term"))
        return structural.search(filters.apply(self.store.table("sections")), terms, limit, min(20 * limit, 1000))

    def search_lexical(self, query, limit: int = 10, filters: FilterSet = FilterSet()) -> DataFrame:
        """BM25 with weighted headings, and windows that hold the whole query; boosts for a heading or an identifier."""
        from .sources.views import tokens

        q, limit = self._queries(query), self._limit(limit)
        chunks, keep = self.store.table("chunks"), ["chunk_id", "path", "authority", "priority", "ordinal", "chunk_ordinal", "heading_path_key"]
        terms = q.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        scored = lexical.score(lexical.build_postings(chunks, ["id", "doc_id"], keep, "heading"), terms, filters.predicate())
        pool = lexical.top_k(scored, min(8 * limit, 800), ["path", "ordinal", "chunk_ordinal"]).drop("rank")
        columns = ["id", "doc_id", *keep, "heading", "heading_key", "start", "end", "chunk"]
        text = chunks.select("chunk_id", "heading", "heading_key", "start", "end", "chunk")
        pool = pool.join(text, "chunk_id").select("query_id", *columns, "score")
        holds = F.contains("heading", "query") | F.contains("chunk", "query")
        exact = filters.apply(chunks).select(columns).join(F.broadcast(q), holds).withColumn("score", F.lit(0.0))
        exact = lexical.top_k(exact, min(4 * limit, 400), ["path", "ordinal", "chunk_ordinal"]).select("query_id", *columns)
        rows = lexical.boosted(pool, exact, q)
        return lexical.top_k(rows, limit, [F.col("authority").desc(), F.col("priority").desc(), "path", "ordinal", "chunk_ordinal"])

    def search_semantic(self, query, limit: int = 10, filters: FilterSet = FilterSet()) -> DataFrame:
        if self.provider is None:
            raise SemanticUnavailable("PROVIDER_UNAVAILABLE", "no embedding provider")
        if self.store.manifest().get("provider") != self.provider_identity:
            raise SemanticUnavailable("IDENTITY_MISMATCH", f"indexed {self.store.manifest().get('provider')}")
        q = self._queries(query).select("query_id", embedder(self.provider)("query").alias("q"))
        return semantic.search(q, self._chunks(filters).withColumnRenamed("vector", "embedding"), self._limit(limit), ["chunk_id"])

    def search(self, query, limit: int = 10, filters: FilterSet = FilterSet(), require_semantic: bool = False) -> DataFrame:
        """All channels that can be had, fused, boosted and spread over sections and documents."""
        limit = self._limit(limit)
        depth = self._limit(max(4 * limit, 20))
        q = self._queries(query)
        columns = ["query_id", "channel", F.col("rank").cast("long"), F.col("id").alias("section"), "heading_key", "path", F.col("start").cast("long"), F.col("end").cast("long")]
        span = lambda rows, channel: rows.withColumn("channel", F.lit(channel)).select(*columns, "authority", "priority", F.sha2("text", 256).alias("sha256"), "text")
        exact = self.search_exact(q, depth, filters)
        exact = exact.withColumn("start", F.lit(0)).withColumn("end", F.length("source_text")).withColumn("text", F.col("source_text"))
        hits = span(exact, "structural").unionByName(span(self.search_lexical(q, depth, filters).withColumn("text", F.col("chunk")), "bm25"))
        try:
            hits = hits.unionByName(span(self.search_semantic(q, depth, filters).withColumn("text", F.col("chunk")), "semantic"))
        except SemanticUnavailable:
            if require_semantic:
                raise
        direct = F.filter("_terms", lambda t: F.contains(F.col("heading_key"), canonical_heading(F.regexp_replace(t, "^#", ""))))
        wanted = q.select("query_id", canonical_heading(F.col("query")).alias("_key"), structural_terms(F.col("query")).alias("_terms"))
        boost = F.when(F.col("heading_key") == F.col("_key"), hybrid.HEADING_BOOST).otherwise(0.0)
        boost = boost + F.when(F.size("_direct") > 0, hybrid.DIRECT_BOOST + hybrid.TERM_BOOST * F.size("_direct")).otherwise(0.0)
        boost = boost + F.when(F.exists("_direct", lambda t: t.rlike(r"(?i)^CP-\d+$")), hybrid.CHECKPOINT_BOOST).otherwise(0.0)
        hits = hits.join(F.broadcast(wanted), "query_id").withColumn("_direct", direct).withColumn("boost", boost).drop("_key", "_terms", "_direct", "heading_key")
        return hybrid.hybrid(hits, limit)

    def find_symbol(self, symbol: str, limit: int = 10, filters: FilterSet = FilterSet()) -> DataFrame:
        s = self.store.table("symbols").where(ascii_lower(F.col("symbol")) == symbol.lower())
        shown = filters.apply(self.store.table("sections")).select(F.col("id").alias("section"), "doc_id", "path", "heading", "authority", "priority")
        return s.join(shown, "section").orderBy(F.col("confidence").desc(), F.col("authority").desc(), F.col("priority").desc(), "section").limit(self._limit(limit))

    def references(self, section: str, incoming: bool = False, edge_type: str | None = None) -> DataFrame:
        """Edges of a section, with what they lead to: target (of a resolved edge) and candidates (id, path, heading)."""
        edges = self.store.table("edges")
        if edge_type:
            edges = edges.where(F.col("edge_type") == edge_type)
        ids = F.filter(F.split("targets", ","), lambda x: x != "")
        edges = edges.where(F.array_contains(ids, section) if incoming else F.col("source") == section)
        shown = self.store.table("sections").select(F.col("id").alias("_id"), F.struct("id", "path", "heading").alias("_found"))
        listed = edges.withColumn("_id", F.explode_outer(ids)).join(shown, "_id", "left")
        rows = listed.groupBy("source", "edge_type", "label", "status", "targets").agg(F.array_sort(F.collect_list("_found")).alias("candidates"))
        return rows.withColumn("target", F.when(F.col("status") == "RESOLVED", F.get("candidates", F.lit(0)))).orderBy("edge_type", "label", "source")

    def dependencies(self, section: str) -> DataFrame:
        return self.references(section, edge_type="DEPENDS_ON")

    def section(self, section: str) -> DataFrame:
        found = self.store.table("sections").where(F.col("id") == section)
        if row := found.select("path").first():
            self._fresh(row["path"])
        return found

    def outline(self, path: str) -> DataFrame:
        self._fresh(path)
        return self.store.table("sections").where(F.col("path") == path).select("id", "ordinal", "level", "heading", "start_line", "end_line").orderBy("ordinal")

    def document_sections(self, path: str) -> DataFrame:
        return self.store.table("sections").where(F.col("path") == path).orderBy("ordinal")

    def section_ids(self, path: str) -> list[str]:
        return [r["id"] for r in self.document_sections(path).select("id", "ordinal").collect()]

    def chunk_count(self) -> int:
        return self.store.table("chunks").count()

    def lines(self, path: str, first: int, last: int) -> DataFrame:
        self._fresh(path)
        workspace = W.load(self.root)
        one = replace(workspace, documents=tuple(d for d in workspace.documents if d.path == path))
        sources = W.read_sources(self.spark, self.root, one).select("path", "text")
        own = self.store.table("sections").where(F.col("path") == path).drop("sha256", "source_text")
        return structural.lines(own, sources, first, last, "path")

    def _documents(self, document: str | None, rows: DataFrame) -> DataFrame:
        if document is None:
            return rows
        known = self.store.table("documents").where((F.col("path") == document) | (F.col("doc_id") == document)).select("doc_id")
        return rows.join(known, "doc_id", "left_semi")

    def checkpoint(self, name: str, document: str | None = None) -> DataFrame:
        found = self._documents(document, self.store.table("checkpoints").where(F.upper("checkpoint_id") == name.upper()))
        best = pack.best_checkpoints(found).collect()
        if best and best[0]["status"] == "AMBIGUOUS":
            raise pack.AmbiguousCheckpoint(name)
        return found.join(self.spark.createDataFrame([(b["doc_id"],) for b in best], "doc_id string"), "doc_id")

    def checkpoint_context(self, name: str, document: str | None = None, budget: int = 15_000, strict: bool = False) -> dict:
        """A checkpoint with its dependencies, references, interfaces, errors, security rules and context pack."""
        return planner.checkpoint_context(self, name, document, budget, strict)

    def context_pack(self, task: str, budget: int = 7000, filters: FilterSet = FilterSet(), strict: bool = False, require_semantic: bool = False, document: str | None = None) -> dict:
        """Evidence for a task by category, within the budget, with its coverage, omissions, ambiguities and conflicts."""
        return planner.context_pack(self, task, budget, filters, strict, require_semantic, document)
