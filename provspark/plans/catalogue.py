"""Queries over the whole tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import fusion, identity, lexical, markdown, overlap, semantic, structural
from ..operators.filters import FilterSet
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


SHOWN = ["doc_id", "path", "authority", "priority"]
_DOCS = "SELECT doc_id, path, authority, priority FROM v_docs WHERE "


@query(V.sql("SELECT doc_id, path, authority, priority, sha256, CAST(length(text) AS BIGINT) AS n_chars FROM v_docs", "v_docs"))
def doc_provenance(spark, sf_dir):
    return V.docs(spark, sf_dir).select(*SHOWN, "sha256", F.length("text").cast("long").alias("n_chars"))


NAMED = frozenset({"docs/src1/1.md", "docs/src5/5.md", "docs/src2/22.md", "17", "230"})


@query(V.sql(_DOCS + "path IN ('docs/src1/1.md', 'docs/src5/5.md', 'docs/src2/22.md', '17', '230') OR CAST(doc_id AS VARCHAR) IN ('docs/src1/1.md', 'docs/src5/5.md', 'docs/src2/22.md', '17', '230')", "v_docs"))
def filter_documents(spark, sf_dir):
    return FilterSet(documents=NAMED).apply(V.docs(spark, sf_dir)).select(SHOWN)


@query(V.sql(_DOCS + "path NOT IN ('docs/src1/1.md', 'docs/src5/5.md', 'docs/src2/22.md', '17', '230')", "v_docs"))
def filter_exclude(spark, sf_dir):
    return FilterSet(exclude_documents=NAMED).apply(V.docs(spark, sf_dir)).select(SHOWN)


@query(V.sql(_DOCS + "authority >= 3", "v_docs"))
def filter_authority_floor(spark, sf_dir):
    return FilterSet(authority_floor=3).apply(V.docs(spark, sf_dir)).select(SHOWN)


@query(V.sql(_DOCS + "authority IN (1, 4)", "v_docs"))
def filter_authorities(spark, sf_dir):
    return FilterSet(authorities=frozenset({1, 4})).apply(V.docs(spark, sf_dir)).select(SHOWN)


@query(V.sql(_DOCS + "starts_with(lower(path), 'docs/src1/')", "v_docs"))
def filter_scope(spark, sf_dir):
    return FilterSet(scope="Docs/SRC1/").apply(V.docs(spark, sf_dir)).select(SHOWN)


def _md_sections(spark, sf_dir):
    return markdown.sections(V.markdown(spark, sf_dir), "conv_id")


_SECTION_VIEWS = ("v_md", "v_lines", "v_headings", "v_sections")
_ROLE_KEY = "trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-')"


@query(V.sql(f"""SELECT s.conv_id, s.ordinal, s.heading FROM v_sections s JOIN v_sections r ON s.conv_id = r.conv_id AND r.ordinal = 0
 WHERE {_ROLE_KEY.replace('heading', 'r.heading')} = 'conversation-7'""", *_SECTION_VIEWS))
def filter_heading_prefix(spark, sf_dir):
    rows = _md_sections(spark, sf_dir)
    return FilterSet(heading_prefix=("conversation-7",)).apply(rows, document_id="conv_id").select("conv_id", "ordinal", "heading")


@query(V.sql("""SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start_offset, CAST(length(ls[i]) AS BIGINT) AS n_chars
 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v_docs))""", "v_docs"))
def line_offsets(spark, sf_dir):
    rows = markdown.line_offsets(V.docs(spark, sf_dir), ["doc_id"], F.split("text", "\n", -1))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.col("start").alias("start_offset"), F.length("content").cast("long").alias("n_chars"))


@query(V.sql("""SELECT conv_id, ordinal, heading, start_line + 1 AS start_line, end_line, piece, sha256(piece) AS sha256 FROM (
 SELECT s.conv_id, s.ordinal, s.heading, greatest(s.start_line, 1) AS start_line, least(s.end_line, 6) AS end_line,
  (SELECT string_agg(l.content, chr(10) ORDER BY l.line) FROM v_lines l WHERE l.conv_id = s.conv_id AND l.line >= greatest(s.start_line, 1) AND l.line < least(s.end_line, 6)) AS piece
 FROM v_sections s WHERE s.start_line < 6 AND s.end_line > 1)""", *_SECTION_VIEWS))
def get_lines_range(spark, sf_dir):
    """Lines 2 to 6 of every document, by section."""
    md = V.markdown(spark, sf_dir)
    return structural.lines(_md_sections(spark, sf_dir), md, 2, 6, "conv_id").select("conv_id", "ordinal", "heading", "start_line", "end_line", "piece", "sha256")


@query(V.sql("SELECT conv_id, ordinal, level, heading, start_line, end_line FROM v_sections", *_SECTION_VIEWS))
def section_outline(spark, sf_dir):
    return _md_sections(spark, sf_dir).select("conv_id", "ordinal", "level", "heading", "start_line", "end_line")


@query(V.sql("""SELECT s.conv_id, s.ordinal, (SELECT max(p.ordinal) FROM v_sections p WHERE p.conv_id = s.conv_id AND p.ordinal < s.ordinal AND p.level < s.level) AS parent FROM v_sections s""", *_SECTION_VIEWS))
def section_parent(spark, sf_dir):
    return _md_sections(spark, sf_dir).select("conv_id", "ordinal", "parent")


@query(V.sql("""SELECT conv_id, ordinal, CASE WHEN level = 1 THEN heading ELSE 'Conversation ' || conv_id || ' > ' || heading END AS heading_path, row_number() OVER (PARTITION BY conv_id, level, heading ORDER BY ordinal) AS occurrence FROM v_sections""", *_SECTION_VIEWS))
def section_path_occurrence(spark, sf_dir):
    return _md_sections(spark, sf_dir).select("conv_id", "ordinal", F.array_join("heading_path", " > ").alias("heading_path"), "occurrence")


@query(V.sql("""SELECT a.conv_id, a.ordinal AS root, b.ordinal AS member FROM v_sections a JOIN v_sections b ON a.conv_id = b.conv_id AND b.ordinal > a.ordinal
 WHERE NOT EXISTS (SELECT 1 FROM v_sections x WHERE x.conv_id = a.conv_id AND x.ordinal > a.ordinal AND x.ordinal <= b.ordinal AND x.level <= a.level)""", *_SECTION_VIEWS))
def subtree_members(spark, sf_dir):
    return markdown.subtree(_md_sections(spark, sf_dir), "conv_id")


def _windows(spark, sf_dir):
    return V.windows(V.docs(spark, sf_dir), SHOWN)


@query(V.sql("SELECT doc_id, ordinal, start_offset, CAST(length(chunk) AS BIGINT) AS n_chars, sha256(chunk) AS sha256 FROM v_windows", "v_docs", "v_windows"))
def window_chunks(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "ordinal", "start_offset", F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("sha256"))


@query(V.sql("""SELECT a.doc_id, a.ordinal AS left_ordinal, b.ordinal AS right_ordinal, CAST(least(a.start_offset + length(a.chunk), b.start_offset + length(b.chunk)) - b.start_offset AS BIGINT) AS shared
 FROM v_windows a JOIN v_windows b ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal AND a.start_offset < b.start_offset + length(b.chunk) AND b.start_offset < a.start_offset + length(a.chunk)""", "v_docs", "v_windows"))
def window_overlap_pairs(spark, sf_dir):
    spans = _windows(spark, sf_dir).select("doc_id", "ordinal", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("chunk")).alias("end"))
    pairs = overlap.overlapping_pairs(spans, "doc_id", "ordinal")
    return pairs.select(F.col("a.doc_id"), F.col("a.ordinal").alias("left_ordinal"), F.col("b.ordinal").alias("right_ordinal"), (F.least("a.end", "b.end") - F.col("b.start")).cast("long").alias("shared"))


@query(V.sql("""SELECT doc_id, CAST(CASE WHEN strlen(text) = 0 THEN 0 ELSE ceil(strlen(text) / 4.0) + 2 END AS BIGINT) AS embedding_tokens, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS generic_tokens, CAST(strlen(text) AS BIGINT) AS byte_bound FROM v_docs""", "v_docs"))
def token_estimates(spark, sf_dir):
    return V.docs(spark, sf_dir).select("doc_id", fn.embedding_tokens(F.col("text")).alias("embedding_tokens"), fn.generic_tokens(F.col("text")).alias("generic_tokens"), fn.byte_bound(F.col("text")).alias("byte_bound"))


@query(V.sql("""SELECT doc_id, CASE WHEN k = '' THEN 'section' ELSE k END AS heading_key FROM (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM v_docs WHERE length(text) = strlen(text))""", "v_docs"))
def canonical_heading_ascii(spark, sf_dir):
    d = V.docs(spark, sf_dir).where(F.length("text") == F.octet_length("text"))
    return d.select("doc_id", fn.canonical_heading(F.get(F.split("text", "\n", -1), F.lit(0))).alias("heading_key"))


@query()
def canonical_heading_unicode(spark, sf_dir):
    return V.docs(spark, sf_dir).select("doc_id", fn.canonical_heading(F.get(F.split("text", "\n", -1), F.lit(0))).alias("heading_key"))


#: The structural terms of the batch.
TERMS = [(1, "Turn 1 assistant"), (2, "turn 0"), (3, "Conversation 12"), (4, "the of"), (5, "conversations/3.md"), (6, "que la"), (7, "Conversation 1")]


@query(V.sql("""SELECT query_id, conv_id, ordinal, match_rank, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_rank, path, ordinal) AS rank FROM (
 SELECT q.query_id, s.conv_id, s.path, s.ordinal, CASE WHEN s.key = q.key THEN 0 WHEN starts_with(s.key, q.key) THEN 1 ELSE 2 END AS match_rank
 FROM (SELECT conv_id, path, ordinal, """ + _ROLE_KEY + """ AS key, (SELECT string_agg(l.content, chr(10) ORDER BY l.line) FROM v_lines l WHERE l.conv_id = s.conv_id AND l.line >= s.start_line AND l.line < s.end_line) AS body FROM v_sections s) s,
 (SELECT query_id, term, trim(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM (VALUES """ + ", ".join(f"({a}, '{b}')" for a, b in TERMS) + """) t(query_id, term)) q
 WHERE s.key = q.key OR starts_with(s.key, q.key) OR contains(s.body, q.term) OR s.path = q.term)) WHERE rank <= 10""", *_SECTION_VIEWS))
def structural_search_batch(spark, sf_dir):
    md = V.markdown(spark, sf_dir)
    rows = markdown.section_text(_md_sections(spark, sf_dir), md, "conv_id").join(md.select("conv_id", "path"), "conv_id")
    terms = spark.createDataFrame(TERMS, "query_id int, term string")
    return structural.search(rows, terms, 10).select("query_id", "conv_id", "ordinal", F.col("match_rank"), F.col("rank"))


@query(V.sql("""SELECT query_id, doc_id, ordinal, rank FROM (SELECT q.query_id, w.doc_id, w.ordinal, row_number() OVER (PARTITION BY q.query_id ORDER BY w.path, w.ordinal) AS rank
 FROM v_windows w JOIN (SELECT item_id AS query_id, string_split(text, '.')[1] AS term FROM benchmark) q ON contains(w.chunk, q.term)) WHERE rank <= 20""", "v_docs", "v_windows"))
def exact_substring_search(spark, sf_dir):
    """Windows that hold each benchmark item's first sentence."""
    q = _phrases(spark, sf_dir).withColumn("terms", F.lit(None).cast("array<string>"))
    return lexical.search(_windows(spark, sf_dir), q, 20, _BY_PATH, _KEPT).select("query_id", "doc_id", "ordinal", "rank")


_KEPT = ["doc_id", "ordinal", "path", "authority", "priority"]
_BY_PATH = [("path", False), ("ordinal", False)]


def _phrases(spark, sf_dir):
    """query_id, phrase: the first sentence of each benchmark text."""
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.get(F.split("text", r"\."), F.lit(0)).alias("phrase"))


def _index(spark, sf_dir):
    return lexical.build_postings(_windows(spark, sf_dir), ["doc_id", "ordinal"], ["path", "authority", "priority"])


def _bm25(spark, sf_dir, whole, k, predicate=None):
    return lexical.search(_windows(spark, sf_dir), V.queries(spark, sf_dir, whole), k, _BY_PATH, _KEPT, predicate)


def _whole(f):
    """Adds the query over all tokens of the benchmark texts, for which there is no SQL, beside the one over the first five."""

    def run(spark, sf_dir):
        return f(spark, sf_dir, whole=True)

    QUERIES[f"{f.__name__}_whole"] = run
    return f


_BM25_VIEWS = ("v_docs", "v_windows", "v_terms", "v_query_terms")
_BM25 = """
 lens AS (SELECT w.doc_id, w.ordinal, w.path, w.authority, w.priority, w.chunk, len(regexp_extract_all(lower(w.chunk), '[\\p{L}\\p{N}_.@:-]+')) AS n FROM v_windows w),
 stats AS (SELECT count(*) AS n_chunks, avg(n) AS mean_tokens FROM lens),
 tf AS (SELECT doc_id, ordinal, term, count(*) AS tf FROM v_terms WHERE term IN (SELECT term FROM v_query_terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bm AS (SELECT q.query_id, l.doc_id, l.ordinal, l.path, l.authority, l.priority,
   sum(greatest(ln((n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean_tokens))) AS score
   FROM v_query_terms q JOIN tf USING (term) JOIN df USING (term) JOIN lens l ON l.doc_id = tf.doc_id AND l.ordinal = tf.ordinal, stats GROUP BY ALL)
"""


def _bm25_sql(body: str) -> str:
    return V.sql("", *_BM25_VIEWS).rstrip() + "," + _BM25 + body


@query(_bm25_sql("SELECT CAST(n_chunks AS BIGINT) AS n_chunks, round(mean_tokens, 6) AS mean_tokens FROM stats"))
def bm25_stats(spark, sf_dir):
    return _index(spark, sf_dir).statistics.select("n_chunks", F.round("mean_tokens", 6).alias("mean_tokens"))


_TOP = "SELECT query_id, doc_id, ordinal, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, ordinal) AS rank FROM bm{where}) WHERE rank <= 10"


@query(_bm25_sql(_TOP.format(where="")))
@_whole
def bm25_topk_batch(spark, sf_dir, whole=False):
    return _bm25(spark, sf_dir, whole, 10).select("query_id", "doc_id", "ordinal", F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql(_TOP.format(where=" WHERE authority >= 3")))
@_whole
def bm25_filtered_topk(spark, sf_dir, whole=False):
    return _bm25(spark, sf_dir, whole, 10, FilterSet(authority_floor=3).predicate()).select("query_id", "doc_id", "ordinal", F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql("""SELECT query_id, doc_id, ordinal, round(score, 6) AS score, channels, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, authority DESC, priority DESC, path, ordinal) AS rank FROM (
  SELECT query_id, doc_id, ordinal, path, authority, priority, sum(score) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM (
   SELECT query_id, doc_id, ordinal, path, authority, priority, score, 'bm25' AS channel FROM bm
   UNION ALL SELECT q.query_id, doc_id, ordinal, path, authority, priority, 2.0, 'exact' FROM v_windows w JOIN (SELECT item_id AS query_id, string_split(text, '.')[1] AS term FROM benchmark) q ON contains(w.chunk, q.term))
  GROUP BY ALL)) WHERE rank <= 10"""))
@_whole
def lexical_union_boosted(spark, sf_dir, whole=False):
    """BM25 rows and rows with the whole phrase, which adds 2 to the score."""
    q = V.queries(spark, sf_dir, whole).join(_phrases(spark, sf_dir), "query_id")
    order = [("authority", True), ("priority", True), *_BY_PATH]
    top = lexical.search(_windows(spark, sf_dir), q, 10, order, _KEPT)
    top = top.withColumn("channels", F.concat_ws(",", F.when(F.col("matched"), "bm25"), F.when(F.col("exact"), "exact")))
    return top.select("query_id", "doc_id", "ordinal", F.round("score", 6).alias("score"), "channels", "rank")


_COS = """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
 FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 {where})) WHERE rank <= 10"""


@query(_COS.format(where=""))
def cosine_topk_batch(spark, sf_dir):
    e = V.embeddings(spark, sf_dir)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return semantic.search(q, e, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_COS.format(where="AND v.label IN (1, 2)"))
def cosine_label_filtered(spark, sf_dir):
    e = V.embeddings(spark, sf_dir)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return semantic.search(q, e.where(F.col("label").isin(1, 2)), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_COS.format(where=""))
def cosine_topk_blocks(spark, sf_dir):
    """The same search for query tables that grow with the vectors: blocks against blocks."""
    e = V.embeddings(spark, sf_dir)
    return semantic.search_blocks(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e, 10)


@query(_bm25_sql("""SELECT query_id, doc_id, ordinal, round(score, 9) AS score, channels, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score / 0.02, 0) DESC, authority DESC, priority DESC, round(score, 9) DESC, doc_id, ordinal) AS rank FROM (
 SELECT query_id, doc_id, ordinal, authority, priority, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM (
  SELECT query_id, doc_id, ordinal, authority, priority, rank, 'bm25' AS channel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, ordinal) AS rank FROM bm) WHERE rank <= 20
  UNION ALL SELECT query_id, doc_id, ordinal, authority, priority, rank, 'structural' FROM (
   SELECT q.query_id, w.*, row_number() OVER (PARTITION BY q.query_id ORDER BY w.path, w.ordinal) AS rank FROM v_windows w JOIN (SELECT item_id AS query_id, string_split(text, '.')[1] AS term FROM benchmark) q ON contains(w.chunk, q.term)) WHERE rank <= 20)
 GROUP BY query_id, doc_id, ordinal, authority, priority)) WHERE rank <= 10"""))
@_whole
def rrf_fusion(spark, sf_dir, whole=False):
    key = ["doc_id", "ordinal", "authority", "priority"]
    bm = _bm25(spark, sf_dir, whole, 20).withColumn("channel", F.lit("bm25"))
    exact = exact_substring_search(spark, sf_dir).join(V.docs(spark, sf_dir).select("doc_id", "authority", "priority"), "doc_id").withColumn("channel", F.lit("structural"))
    ranked = bm.select("query_id", "channel", "rank", *key).unionByName(exact.select("query_id", "channel", "rank", *key))
    fused = fusion.reciprocal_ranks(ranked, key)
    return fusion.fused_order(fused, ["doc_id", "ordinal"], 10).select("query_id", "doc_id", "ordinal", F.round("score", 9).alias("score"), "channels", "rank")


@query(_bm25_sql("""SELECT query_id, doc_id, ordinal, in_group FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, ordinal) AS in_group FROM bm) WHERE in_group <= 3"""))
@_whole
def span_cap_per_section(spark, sf_dir, whole=False):
    return lexical.span_cap(_windows(spark, sf_dir), V.queries(spark, sf_dir, whole), 3, "doc_id", ["doc_id", "ordinal"])


@query(V.sql("""SELECT a, b, round(j, 9) AS jaccard FROM (
 SELECT x.id AS a, y.id AS b, len(list_intersect(x.items, y.items)) / CAST(len(x.items) + len(y.items) - len(list_intersect(x.items, y.items)) AS DOUBLE) AS j
 FROM sets x JOIN sets y ON x.id < y.id AND least(len(x.items), len(y.items)) >= 0.92 * greatest(len(x.items), len(y.items))) WHERE j >= 0.92 - 1e-12""".replace("FROM sets", "FROM (SELECT min(doc_id) AS id, items FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.@:-]+'))) AS items FROM v_docs) WHERE len(items) > 0 GROUP BY items)").replace("JOIN sets", "JOIN (SELECT min(doc_id) AS id, items FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.@:-]+'))) AS items FROM v_docs) WHERE len(items) > 0 GROUP BY items)"), "v_docs"))
def jaccard_near_duplicates(spark, sf_dir):
    """Pairs of documents with alike token sets (copies stand behind the least doc_id)."""
    sets = V.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_distinct(V.tokens(F.col("text"))).alias("items"))
    return overlap.jaccard_pairs(sets, 0.92).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(V.sql("SELECT sha256, count(*) AS n, min(doc_id) AS first_doc FROM v_docs GROUP BY sha256 HAVING count(*) > 1", "v_docs"))
def exact_duplicates(spark, sf_dir):
    return V.docs(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_PREV = "v_prev AS (SELECT path, sha256 FROM v_docs WHERE doc_id % 10 <> 0), v_next AS (SELECT CASE WHEN doc_id % 10 = 3 THEN path || '.moved.md' ELSE path END AS path, CASE WHEN doc_id % 10 = 2 THEN sha256(text || '!') ELSE sha256 END AS sha256 FROM v_docs WHERE doc_id % 10 <> 1)"


def _before_after(spark, sf_dir):
    """Two states of the corpus: some documents come, go, change or move."""
    d = V.docs(spark, sf_dir)
    r = F.col("doc_id") % 10
    before = d.where(r != 0).select("doc_id", "path", "sha256", "text")
    text = F.when(r == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = d.where(r != 1).select("doc_id", F.when(r == 3, F.concat("path", F.lit(".moved.md"))).otherwise(F.col("path")).alias("path"), F.sha2(text, 256).alias("sha256"), text.alias("text"))
    return before, after


_IDENTITY = V.sql("", "v_docs").rstrip() + ", " + _PREV + """,
 states AS (SELECT n.path, n.sha256, o.path AS old_path, o.sha256 AS old_sha FROM v_next n FULL JOIN v_prev o ON n.path = o.path),
 added AS (SELECT path, sha256 FROM states WHERE old_path IS NULL), gone AS (SELECT old_path, old_sha AS sha256 FROM states WHERE path IS NULL),
 pairs AS (SELECT sha256 FROM (SELECT sha256 FROM added GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT sha256 FROM gone GROUP BY 1 HAVING count(*) = 1) USING (sha256)),
 renamed AS (SELECT a.path, g.old_path FROM added a JOIN pairs USING (sha256) JOIN gone g USING (sha256)),
 plan AS (SELECT path, old_path, CASE WHEN sha256 = old_sha THEN 'unchanged' ELSE 'changed' END AS status FROM states WHERE path IS NOT NULL AND old_path IS NOT NULL
  UNION ALL SELECT path, old_path, 'renamed' FROM renamed UNION ALL SELECT path, NULL, 'added' FROM added WHERE path NOT IN (SELECT path FROM renamed)
  UNION ALL SELECT NULL, old_path, 'removed' FROM gone WHERE old_path NOT IN (SELECT old_path FROM renamed))
"""


@query(_IDENTITY + "SELECT status, count(*) AS n FROM plan GROUP BY status")
def sync_document_diff(spark, sf_dir):
    before, after = _before_after(spark, sf_dir)
    return identity.plan_identity(before, after).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_IDENTITY + "SELECT path, old_path FROM plan WHERE status = 'renamed'")
def rename_detection(spark, sf_dir):
    before, after = _before_after(spark, sf_dir)
    return identity.plan_identity(before, after).where("status = 'renamed'").select("path", "old_path")


_CHUNK_DIFF = V.sql("", "v_docs").rstrip() + """,
 oldw AS (SELECT doc_id, i AS ordinal, sha256(substring(text, CAST(i * 1020 + 1 AS BIGINT), 1200)) AS sha FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 180) / 1020.0) AS BIGINT)))) AS i FROM v_docs WHERE doc_id % 10 <> 0)),
 neww AS (SELECT doc_id, i AS ordinal, sha256(substring(text, CAST(i * 1020 + 1 AS BIGINT), 1200)) AS sha FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 180) / 1020.0) AS BIGINT)))) AS i FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END AS text FROM v_docs WHERE doc_id % 10 <> 1)))
"""


def _chunk_states(spark, sf_dir):
    return [V.windows(x, ["doc_id"]).select("doc_id", "ordinal", F.sha2("chunk", 256).alias("sha")) for x in _before_after(spark, sf_dir)]


@query(_CHUNK_DIFF + "SELECT count(*) FILTER (WHERE o.doc_id IS NULL) AS added, count(*) FILTER (WHERE n.doc_id IS NULL) AS removed, count(*) FILTER (WHERE o.sha <> n.sha) AS changed, count(*) FILTER (WHERE o.sha = n.sha) AS unchanged FROM oldw o FULL JOIN neww n ON o.doc_id = n.doc_id AND o.ordinal = n.ordinal")
def sync_chunk_diff(spark, sf_dir):
    before, after = _chunk_states(spark, sf_dir)
    return identity.diff_rows(before, after, ["doc_id", "ordinal"], "sha")


def _keyed(rows):
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), F.col("sha").alias("source_sha"), F.sha2(F.concat(F.lit("e"), "sha"), 256).alias("embedding_sha"))


@query(_CHUNK_DIFF + "SELECT CAST(count(*) FILTER (WHERE o.sha = n.sha) AS BIGINT) AS reused, CAST(count(*) FILTER (WHERE o.sha IS NULL OR o.sha <> n.sha) AS BIGINT) AS to_embed FROM neww n LEFT JOIN oldw o ON o.doc_id = n.doc_id AND o.ordinal = n.ordinal")
def vector_reuse(spark, sf_dir):
    before, after = (_keyed(x) for x in _chunk_states(spark, sf_dir))
    joined = identity.reuse_vectors(after, before.withColumn("vector", F.lit(1)))
    return joined.agg(F.count_if(F.col("vector").isNotNull()).alias("reused"), F.count_if(F.col("vector").isNull()).alias("to_embed"))


@query(_CHUNK_DIFF + "SELECT n.doc_id || ':' || n.ordinal AS chunk_id FROM neww n LEFT JOIN oldw o ON o.doc_id = n.doc_id AND o.ordinal = n.ordinal AND o.sha = n.sha WHERE o.sha IS NULL")
def vectors_missing(spark, sf_dir):
    before, after = (_keyed(x) for x in _chunk_states(spark, sf_dir))
    return identity.missing_vectors(after, before).select("chunk_id")


@query("""SELECT count(*) FILTER (WHERE vec_id % 17 = 0) AS missing, count(*) FILTER (WHERE vec_id % 17 <> 0 AND vec_id % 13 = 0) AS stale, CAST(0 AS BIGINT) AS wrong_size, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS zero, count(*) FILTER (WHERE vec_id % 17 <> 0 AND vec_id % 13 <> 0) AS sound FROM embeddings""")
def vector_audit(spark, sf_dir):
    e = V.embeddings(spark, sf_dir)
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.lit("now").alias("source_sha"))
    vectors = e.where("vec_id % 17 <> 0").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 13 == 0, "old").otherwise("now").alias("source_sha"), F.col("embedding").alias("vector"))
    return identity.audit_vectors(chunks, vectors, 64)


@query(V.sql("", "v_docs").rstrip() + ", " + _PREV + " SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'NOT_INDEXED' WHEN n.path IS NULL THEN 'MISSING_SOURCE' WHEN n.sha256 <> o.sha256 THEN 'STALE' ELSE 'FRESH' END AS status FROM v_next n FULL JOIN v_prev o ON n.path = o.path")
def status_freshness(spark, sf_dir):
    before, after = _before_after(spark, sf_dir)
    return identity.freshness(after, before)


@query(V.sql("""SELECT CAST(sum(CAST('0x' || substring(h, 1, 8) AS BIGINT)) AS BIGINT) AS sum0, CAST(sum(CAST('0x' || substring(h, 9, 8) AS BIGINT)) AS BIGINT) AS sum1, CAST(sum(CAST('0x' || substring(h, 17, 8) AS BIGINT)) AS BIGINT) AS sum2, CAST(sum(CAST('0x' || substring(h, 25, 8) AS BIGINT)) AS BIGINT) AS sum3, count(*) AS documents
 FROM (SELECT sha256(path || '|' || authority || '|' || priority || '|' || sha256) AS h FROM v_docs)""", "v_docs"))
def fingerprint(spark, sf_dir):
    return identity.fingerprint(V.docs(spark, sf_dir))


@query(_bm25_sql("""SELECT round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (
 SELECT c.query_id, min(h.rank) AS first FROM (SELECT item_id AS query_id FROM benchmark) c LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, ordinal) AS rank FROM bm) WHERE rank <= 10) h
  ON h.query_id = c.query_id AND EXISTS (SELECT 1 FROM v_docs d JOIN benchmark b ON b.item_id = c.query_id WHERE d.doc_id = h.doc_id AND contains(d.text, string_split(b.text, '.')[1])) GROUP BY c.query_id)"""))
@_whole
def eval_recall_mrr(spark, sf_dir, whole=False):
    """How well BM25 finds a document that holds the item's first sentence."""
    q = _phrases(spark, sf_dir)
    hits = bm25_topk_batch(spark, sf_dir, whole).select("query_id", "doc_id", "rank").join(q, "query_id")
    # only documents among the hits are asked for the phrase; the hits are ten a query
    found = V.docs(spark, sf_dir).select("doc_id", "text").join(F.broadcast(hits), "doc_id").where(F.contains("text", "phrase"))
    hits = found.groupBy("query_id").agg(F.min("rank").alias("first"))
    return structural.retrieval_metrics(q.select("query_id").join(hits, "query_id", "left"))


@query(_bm25_sql("""SELECT CAST((SELECT sum(length(text)) FROM v_docs) AS BIGINT) AS corpus_chars, CAST(sum(length(chunk)) AS BIGINT) AS returned_chars, round(1 - sum(length(chunk)) / (SELECT sum(length(text)) FROM v_docs)::DOUBLE, 6) AS compression FROM (
 SELECT DISTINCT h.doc_id, h.ordinal, w.chunk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, ordinal) AS rank FROM bm) h JOIN v_windows w ON w.doc_id = h.doc_id AND w.ordinal = h.ordinal WHERE rank <= 10)"""))
@_whole
def corpus_compression(spark, sf_dir, whole=False):
    found = bm25_topk_batch(spark, sf_dir, whole).select("doc_id", "ordinal").distinct()
    returned = _windows(spark, sf_dir).join(F.broadcast(found), ["doc_id", "ordinal"]).agg(F.sum(F.length("chunk")).alias("returned_chars"))
    corpus = V.docs(spark, sf_dir).agg(F.sum(F.length("text")).alias("corpus_chars"))
    return corpus.crossJoin(returned).withColumn("compression", F.round(1 - F.col("returned_chars") / F.col("corpus_chars"), 6))


@query(V.sql("""SELECT doc_id, ordinal, used FROM (SELECT doc_id, ordinal, CAST(sum(ceil(strlen(chunk) / 3.0)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS used FROM v_windows) WHERE used <= 2000""", "v_docs", "v_windows"))
def budget_fill_prefix(spark, sf_dir):
    """Of every document, the leading windows that fit a budget of 2000 tokens."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return _windows(spark, sf_dir).withColumn("used", F.sum(fn.generic_tokens(F.col("chunk"))).over(w)).where("used <= 2000").select("doc_id", "ordinal", "used")
