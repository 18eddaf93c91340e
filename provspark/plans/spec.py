"""Queries over parsed Markdown: graph, checkpoints, conflicts, classification, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..functions.embed import HashEmbedding, embedder
from ..functions.patterns import QUERY_CLASSES, SYMBOLS
from ..operators import graph, hybrid, markdown, pack, semantic
from ..operators.extract import assertions_of
from ..sources import views as V
from .catalogue import _SECTION_VIEWS, _bm25, _md_sections, _windows, query

#: A small specification in Markdown, which holds every construct: (path, authority, priority, text).
SPEC = [
    (
        "spec/platform.md",
        4,
        10,
        "# Platform\nThe RunManifest ties runs together. See [security](#security).\n## RunManifest\nclass RunManifest holds `network.remove_ingress@1`.\n"
        "## CP-13 - Storage\nGoal: store runs\nThe cache must keep entries.\n## CP-14 - Manifest\nGoal: write the manifest\nDependencies: CP-13, RunManifest\n"
        "Tests:\n- round trip\n- INVALID_EVIDENCE is raised\n### Security\nThe cache must not keep entries.\nRaises NetworkTimeout.\n# §25 Security\nsection 25 binds CP-14.\n",
    ),
    ("spec/notes.md", 1, 0, "Notes\n=====\nCP-14 is described in §25.\n\n```\n# not a heading\nCP-99\n```\n> ## Quoted\n> text\n\n## CP-13\nThe worker is enabled. The worker is disabled.\n"),
    ("spec/history.md", 2, 0, "# History\n## CP-14 - Manifest\nGoal: an older goal\nAPI calls are allowed.\nAPI calls are prohibited.\n"),
]


def _spec(spark, sf_dir):
    """Sections of SPEC, of the Markdown of all conversations and of all documents."""
    columns = ["doc_id", "authority", "priority", "text"]
    d = spark.createDataFrame(SPEC, "doc_id string, authority int, priority int, text string")
    md = V.markdown(spark, sf_dir).select(F.col("path").alias("doc_id"), (F.col("conv_id") % 5).cast("int").alias("authority"), (F.col("conv_id") % 201 - 100).cast("int").alias("priority"), "text")
    docs = V.docs(spark, sf_dir).select(F.col("path").alias("doc_id"), F.col("authority").cast("int").alias("authority"), F.col("priority").cast("int").alias("priority"), "text")
    d = d.select(columns).unionByName(md).unionByName(docs)
    s = markdown.section_text(markdown.sections(d), d)
    return s.join(d.select("doc_id", F.col("doc_id").alias("path"), "authority", "priority"), "doc_id")


@query()
def spec_sections(spark, sf_dir):
    return _spec(spark, sf_dir).select("path", "ordinal", "level", "heading", "parent", "start_line", "end_line", "id")


@query()
def spec_windows(spark, sf_dir):
    return markdown.chunks(_spec(spark, sf_dir)).select("path", "ordinal", "chunk_ordinal", "start", "end", "chunk_id")


@query()
def graph_edges(spark, sf_dir):
    return graph.resolve(graph.mentions(_spec(spark, sf_dir)), graph.declarations(_spec(spark, sf_dir)))


@query()
def graph_symbols(spark, sf_dir):
    return graph.symbols(_spec(spark, sf_dir))


@query()
def find_symbol(spark, sf_dir):
    return graph.symbols(_spec(spark, sf_dir)).where(F.lower("symbol") == "runmanifest")


@query(V.sql("""SELECT p.conv_id, 'PARENT_OF' AS edge_type, c.heading AS label, p.ordinal AS source, c.ordinal AS target FROM v_sections p JOIN v_sections c ON p.conv_id = c.conv_id AND p.level = 1 AND c.level = 2
 UNION ALL SELECT p.conv_id, 'CHILD_OF', p.heading, c.ordinal, p.ordinal FROM v_sections p JOIN v_sections c ON p.conv_id = c.conv_id AND p.level = 1 AND c.level = 2""", *_SECTION_VIEWS))
def graph_parent_child(spark, sf_dir):
    s = _md_sections(spark, sf_dir).withColumn("doc_id", F.col("conv_id"))
    ids = s.select("id", "conv_id", F.col("ordinal"))
    e = graph.parent_edges(s)
    e = e.join(ids.select(F.col("id").alias("source"), "conv_id", F.col("ordinal").alias("s")), "source").join(ids.select(F.col("id").alias("target"), F.col("ordinal").alias("t")), "target")
    return e.select("conv_id", "edge_type", "label", F.col("s").alias("source"), F.col("t").alias("target"))


@query()
def dependencies(spark, sf_dir):
    return graph_edges(spark, sf_dir).where("edge_type = 'DEPENDS_ON'")


#: Mentions and declarations as constants: (source, doc, key) and (key, target, doc, authority, priority, ordinal).
MENTIONED = [("a", "d1", "k1"), ("a", "d1", "k2"), ("b", "d2", "k1"), ("b", "d2", "k3"), ("c", "d3", "k4")]
DECLARED = [("k1", "x", "d1", 1, 0, 3), ("k1", "y", "d3", 4, 0, 1), ("k2", "p", "d2", 2, 5, 1), ("k2", "q", "d3", 2, 5, 2), ("k4", "c", "d3", 4, 0, 1)]


@query("""SELECT m.source, m.key AS label, CASE WHEN count(DISTINCT b.target) = 1 THEN 'RESOLVED' WHEN count(DISTINCT b.target) > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, coalesce(string_agg(b.target, ',' ORDER BY b.ordinal, b.target), '') AS targets
 FROM (VALUES ('a','d1','k1'),('a','d1','k2'),('b','d2','k1'),('b','d2','k3'),('c','d3','k4')) m(source, doc, key) LEFT JOIN (
  SELECT m.source, m.key, d.target, d.ordinal, rank() OVER (PARTITION BY m.source, m.key ORDER BY CASE WHEN m.doc = d.doc THEN 0 ELSE 1 END, d.authority DESC, d.priority DESC) AS place
  FROM (VALUES ('a','d1','k1'),('a','d1','k2'),('b','d2','k1'),('b','d2','k3'),('c','d3','k4')) m(source, doc, key)
  JOIN (VALUES ('k1','x','d1',1,0,3),('k1','y','d3',4,0,1),('k2','p','d2',2,5,1),('k2','q','d3',2,5,2),('k4','c','d3',4,0,1)) d(key, target, doc, authority, priority, ordinal) ON m.key = d.key AND m.source <> d.target) b
 ON b.source = m.source AND b.key = m.key AND b.place = 1 GROUP BY m.source, m.key""")
def reference_resolution(spark, sf_dir):
    m = spark.createDataFrame([(s, d, "REFERENCES", k, k) for s, d, k in MENTIONED], "source string, doc_id string, edge_type string, label string, key string")
    d = spark.createDataFrame(DECLARED, "key string, target string, doc_id string, authority int, priority int, ordinal int")
    return graph.resolve(m, d).select("source", "label", "status", "targets")


@query()
def checkpoint_fields(spark, sf_dir):
    return pack.checkpoints(_spec(spark, sf_dir)).select("doc_id", "checkpoint_id", "title", F.explode("fields").alias("field", "values")).select("doc_id", "checkpoint_id", "title", "field", F.array_join("values", " | ").alias("values"))


@query("""SELECT checkpoint_id, count(*) AS n, min(doc_id) AS doc_id, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM (
 SELECT *, rank() OVER (PARTITION BY checkpoint_id ORDER BY authority DESC, priority DESC) AS place FROM (
  SELECT 'CP-' || (doc_id % 50) AS checkpoint_id, doc_id, doc_id % 5 AS authority, doc_id % 201 - 100 AS priority FROM documents)) WHERE place = 1 GROUP BY checkpoint_id""")
def checkpoint_lookup_tie(spark, sf_dir):
    """One checkpoint id per fifty documents: the best by authority and priority, or a tie."""
    d = V.docs(spark, sf_dir).select(F.concat(F.lit("CP-"), (F.col("doc_id") % 50).cast("string")).alias("checkpoint_id"), "doc_id", "authority", "priority")
    return pack.best_checkpoints(d)


@query()
def conflict_pairs(spark, sf_dir):
    return pack.conflicts(_spec(spark, sf_dir).select(F.concat("path", F.lit("#"), F.col("ordinal").cast("string")).alias("item"), "heading", "source_text"))


@query()
def assertion_extract(spark, sf_dir):
    return _spec(spark, sf_dir).select("path", "ordinal", F.explode(assertions_of("heading", "source_text")).alias("a")).select("path", "ordinal", "a.*")


@query("""SELECT category, CAST(count(*) FILTER (WHERE required) AS BIGINT) AS required, CAST(count(*) FILTER (WHERE required AND selected) AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE ambiguous) AS BIGINT) AS n_ambiguous, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS selected,
 CASE WHEN count(*) FILTER (WHERE ambiguous) > 0 THEN 'AMBIGUOUS' WHEN count(*) FILTER (WHERE required AND selected) < count(*) FILTER (WHERE required) THEN 'PARTIAL' WHEN count(*) FILTER (WHERE selected) > 0 THEN 'COMPLETE' ELSE 'NOT_APPLICABLE' END AS status
 FROM (SELECT 'src' || (doc_id % 11) AS category, doc_id % 3 = 0 AS required, doc_id % 7 <> 0 OR doc_id % 11 < 4 AS selected, doc_id % 11 = 5 AND doc_id % 4 = 0 AS ambiguous FROM documents) GROUP BY category""")
def coverage_rollup(spark, sf_dir):
    d = F.col("doc_id")
    rows = V.docs(spark, sf_dir).select(F.concat(F.lit("src"), (d % 11).cast("string")).alias("category"), (d % 3 == 0).alias("required"), ((d % 7 != 0) | (d % 11 < 4)).alias("selected"), ((d % 11 == 5) & (d % 4 == 0)).alias("ambiguous"))
    return pack.coverage(rows)


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bCP-[0-9]+\\b')) AS BIGINT) AS checkpoint_ids, CAST(len(regexp_extract_all(text, '\\b(?:[A-Z][A-Z0-9]*_[A-Z0-9_]*[0-9][A-Z0-9_]*|[A-Z]+[0-9]{2,})\\b')) AS BIGINT) AS error_codes, CAST(len(regexp_extract_all(text, '(?i)#[a-z0-9][a-z0-9_-]*(?:-[a-z0-9_-]+)*')) AS BIGINT) AS anchors FROM documents WHERE length(text) = strlen(text)""")
def query_classification(spark, sf_dir):
    """Classes that DuckDB's expressions can tell too, over the ASCII documents."""
    d = V.docs(spark, sf_dir).where(F.length("text") == F.octet_length("text"))
    return d.select("doc_id", *[F.size(classify.query_class(F.col("text"), n)).cast("long").alias(n) for n in ("checkpoint_ids", "error_codes", "anchors")])


@query()
def query_classes_all(spark, sf_dir):
    d = V.docs(spark, sf_dir)
    return d.select("doc_id", *[F.size(classify.query_class(F.col("text"), n)).alias(n) for n in QUERY_CLASSES])


@query("""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Za-z_][\\w.-]*@[0-9]+\\b'))) AS symbol FROM documents WHERE length(text) = strlen(text)""")
def symbol_extract_versioned(spark, sf_dir):
    """Over all documents; the SQL, whose classes are ASCII only, looks at ASCII ones."""
    pattern = F.lit("(?U)" + SYMBOLS["versioned"])
    return V.docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", pattern, F.lit(0)))).alias("symbol"))


def _to_embed(spark, sf_dir):
    """Windows whose chunk is to be embedded where it is scored."""
    return _windows(spark, sf_dir).select("doc_id", "ordinal", "path", F.col("chunk").alias("embedding"))


def _query_vectors(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), embedder(HashEmbedding)("text").alias("q"))


@query()
def hash_embedding_search(spark, sf_dir):
    found = semantic.search(_query_vectors(spark, sf_dir), _to_embed(spark, sf_dir), 10, ["path", "ordinal"], HashEmbedding)
    return found.select("query_id", "doc_id", "ordinal", F.round("score", 4).alias("score"), "rank")


@query()
def hybrid_search_batch(spark, sf_dir):
    """BM25 and hash embeddings over windows, fused and spread."""
    depth = 40
    bm = _bm25(spark, sf_dir, True, depth).withColumn("channel", F.lit("bm25"))
    near = semantic.search(_query_vectors(spark, sf_dir), _to_embed(spark, sf_dir), depth, ["path", "ordinal"], HashEmbedding).withColumn("channel", F.lit("semantic"))
    keys = ["query_id", "doc_id", "ordinal", "rank", "channel"]
    hits = bm.select(keys).unionByName(near.select(keys))
    # 40 hits a query and channel; the windows stay where they are
    hits = _windows(spark, sf_dir).join(F.broadcast(hits), ["doc_id", "ordinal"])
    end = F.col("start_offset") + F.length("chunk")
    spans = hits.select(
        "query_id", "channel", F.col("rank").cast("long"), F.lit(0.0).alias("boost"), F.col("path").alias("section"), "path", F.col("start_offset").alias("start"), end.alias("end"), "authority", "priority", F.sha2("chunk", 256).alias("sha256"), F.col("chunk").alias("text")
    )
    return hybrid.hybrid(spans, 10)
