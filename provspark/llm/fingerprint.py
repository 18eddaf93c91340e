"""Canonical exact digests of documents, on DataFrame and SQL functions alone.

Canonical form: NFKC, full case folding, NFKC again, runs of white space to one
space, trimmed.  Spark has no built-in for the first two; its own ICU library is
called by the SQL function ``reflect`` and only for texts that aren't ASCII.
The digest is a wide xxhash (two 64-bit hashes of different seeds).  Documents
are grouped by it, and inside a bucket their canonical bytes are compared; only
one copy of each distinct text leaves a map task, so a text that a third of all
rows repeat costs no more than any other.  Texts that differ in one bucket get
digests with different suffixes.

As an exact digest has no degrees, likeness is 1.0 or 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: White space that is folded: the characters of Unicode's White_Space.
WHITE_SPACE = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Rows in a bucket of neighbouring doc_ids, and the most buckets.
BUCKET_ROWS = 256
MAX_BUCKETS = 4096
_STEP = 64


def canonical(text: Column) -> Column:
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.btrim(F.regexp_replace(plain, WHITE_SPACE, " "), F.lit(" "))


def wide_hash(form: Column) -> Column:
    pad = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(pad(F.xxhash64(form)), pad(F.xxhash64(F.lit("wide"), form)))


def distinct_suffixes(forms: DataFrame) -> DataFrame:
    """Byte comparison inside equal buckets: forms has fp and form.

    Returns fp, form, suffix for the buckets that hold more than one text; none
    unless two texts share a 128-bit hash.
    """
    buckets = forms.groupBy("fp").agg(F.collect_set("form").alias("forms")).where(F.size("forms") > 1)
    return buckets.select("fp", F.posexplode(F.array_sort("forms")).alias("n", "form")).select("fp", "form", F.concat(F.lit("-"), F.col("n").cast("string")).alias("suffix"))


def with_next(docs: DataFrame, payload: list[str]) -> DataFrame:
    """Each row with the next row in descending doc_id (after the last: the first).

    Rows are dealt into buckets of neighbouring doc_ids by quantiles; the first
    row of a bucket is also sent to the end of the bucket before.  Ties are in
    order of text; a null doc_id is the smallest.
    """
    keyed = docs.withColumn("_o", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    rows, top = keyed.agg(F.count(F.lit(1)), F.max("_o")).first()
    buckets = int(min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS)))
    bounds: list[int] = []
    if buckets > 1:
        at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = sorted({b for b in keyed.agg(F.percentile_approx("_o", at, 20_000)).first()[0] if b != top}, reverse=True)
    if bounds:
        all_bounds = F.array(*[F.lit(b).cast("long") for b in bounds])
        coarse = F.array(*[F.lit(b).cast("long") for b in bounds[_STEP - 1 :: _STEP]]) if len(bounds) >= _STEP else F.expr("cast(array() as array<bigint>)")
        step = F.size(F.filter(coarse, lambda b: b >= F.col("_o"))) * _STEP
        keyed = keyed.withColumn("_step", step)
        keyed = keyed.withColumn("_b", F.col("_step") + F.size(F.filter(F.slice(all_bounds, F.col("_step") + 1, _STEP), lambda b: b >= F.col("_o"))))
        first = F.when(F.col("_o") == top, F.lit(len(bounds))).when(F.get(all_bounds, F.col("_b") - 1) == F.col("_o"), F.col("_b") - 1)
    else:
        keyed = keyed.withColumn("_b", F.lit(0))
        first = F.when(F.col("_o") == top, F.lit(0))
    copies = F.when(first.isNull(), F.array(F.col("_b"))).otherwise(F.array(F.col("_b"), first))
    dealt = keyed.select("*", F.posexplode(copies).alias("_ghost", "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("_o").desc(), "text")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload})
    return dealt.where(F.col("_ghost") == 0).drop("_o", "_step", "_b", "_ghost", "_bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    docs needs doc_id and text (null: empty); other columns are ignored.  The
    edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in descending doc_id.  Returns
    one row per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Repeated rows are neighbours;
    an only row is its own next.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = texts.withColumn("form", canonical(F.col("text"))).select("doc_id", "text", wide_hash(F.col("form")).alias("fp"))
    pairs = with_next(hashed, ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_fp", wide_hash(F.col("edited_form")))
    same = lambda equal, form: F.when(equal, F.when(canonical(F.col("text")) == form, 1.0).otherwise(0.0)).otherwise(0.0)
    rows = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        F.col("edited_fp").alias("edited_fingerprint"),
        same(F.col("fp") == F.col("edited_fp"), F.col("edited_form")).alias("near_edited"),
        same(F.col("fp") == F.col("next_fp"), canonical(F.col("next_text"))).alias("near_next"),
        F.xxhash64("text").alias("text_hash"),
    )
    rows = materialize(rows, "fingerprints")
    forms = texts.withColumn("form", canonical(F.col("text"))).select("doc_id", F.xxhash64("text").alias("text_hash"), wide_hash(F.col("form")).alias("fp"), "form")
    unequal = materialize(distinct_suffixes(forms), "unequal")
    if unequal.isEmpty():
        return rows.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
    marks = forms.join(unequal, ["fp", "form"]).groupBy("doc_id", "text_hash").agg(F.first("suffix").alias("suffix"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "suffix")
    joined = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_id"]) & (rows["text_hash"] == marks["_hash"]), "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", F.concat("fp", F.coalesce("suffix", F.lit(""))).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
