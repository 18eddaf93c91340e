"""Line de-duplication across documents, on DataFrame functions alone.

Hashes of long lines are range-partitioned and sorted by document (descending)
and position inside each partition; a streaming window over that order sees the
first occurrence of a key and counts its documents.  A key is dealt over
``SALTS`` ranges by its documents, and what the ranges found is merged by a
partial aggregate; the frequent keys, which are few, come back to the lines by a
broadcast.  So a line that a third of all documents share is no one task's work.  What comes back per document is not text but its keep bitmap,
run-length coded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Ranges that one key may be dealt over.
SALTS = 256
#: Keys with more than this part of all lines are joined by a broadcast; there can't be more such keys.
HOT_KEYS = 10_000
MIN_POINTS = 20
MIN_DOCUMENTS = 3

_SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line):
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Run-length coded keep bitmaps of the documents that lose lines.

    docs needs doc_id and text; other columns are ignored.  Keys of at least
    ``min_points`` code points found in at least ``min_documents`` documents
    (distinct doc_ids, null being one) lose all their lines except in the
    largest doc_id (null is the smallest).  Returns doc_id, text_hash (tells
    rows apart that repeat a doc_id; equal rows share a bitmap), n_dropped and
    bitmap: the runs of zeros as (start, length), by line number from 0.
    Documents that keep everything have no row; null and empty texts are one
    empty line, which is never long enough.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_points)
    hashed = keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("wide"), "key").alias("h2"))
    lines = materialize(hashed, "lines")

    salted = lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id", "pos")
    ordered = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc(), F.col("pos"))
    streamed = salted.repartitionByRange("h1", "h2", "salt").select(
        "h1", "h2", "doc_id", ((F.row_number().over(ordered) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(ordered))).alias("first")
    )
    repeated = streamed.groupBy("h1", "h2").agg(F.count_if("first").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keeper"))
    repeated = materialize(repeated.where(F.col("n") >= min_documents).select("h1", "h2", "rows", "keeper"), "repeated-lines")
    # fewer than HOT_KEYS keys can hold more than their share of all lines: those are broadcast, the rest is even enough to shuffle
    share = F.lit(lines.count() // HOT_KEYS + 1)
    hot = repeated.where(F.col("rows") > share).select("h1", "h2", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot"))
    split = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    often = split.where("hot").select("doc_id", "text_hash", "pos", F.col("hot_keeper").alias("keeper"))
    other = split.where("hot is null").join(repeated.where(F.col("rows") <= share), ["h1", "h2"]).select("doc_id", "text_hash", "pos", "keeper")
    dropped = often.unionByName(other).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gathered = dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
    return gathered.select(
        "doc_id",
        "text_hash",
        F.size("p").cast("long").alias("n_dropped"),
        F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("bitmap"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped appended (such columns of docs are replaced)."""
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_n"), F.col("bitmap").alias("_runs"))
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    joined = docs.join(b, docs["doc_id"].eqNullSafe(b["_id"]) & (F.xxhash64(docs["text"]) == b["_hash"]), "left")
    lines, runs = _lines(docs["text"]), F.col("_runs")
    joined = joined.withColumn("_lines", lines)
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])
    until = lambda i: F.when(i == F.size(runs), F.size("_lines")).otherwise(F.get(runs, i)["start"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice("_lines", after(i) + 1, until(i) - after(i))))
    return joined.withColumns(
        {
            "kept_text": F.when(runs.isNull(), F.coalesce(docs["text"].cast("string"), F.lit(""))).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.col("_n"), F.lit(0).cast("long")),
        }
    ).drop("_id", "_hash", "_n", "_runs", "_lines")


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""
    narrow = docs.select("doc_id", "text")
    return apply_bitmaps(narrow, keep_bitmaps(narrow)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS dropped FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
