"""Incremental sync: which documents, chunks and vectors changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new(path, sha256): path, old_path, status of every document.

    kept or changed by path; renamed where exactly one missing old and one new
    path share the hash; else added or removed.
    """
    o = old.select(F.col("path").alias("old_path"), F.col("sha256").alias("old_sha"))
    both = new.join(o, new["path"] == o["old_path"], "full_outer")
    same = F.when(F.col("sha256") == F.col("old_sha"), "unchanged").otherwise("changed")
    kept = both.where(F.col("path").isNotNull() & F.col("old_path").isNotNull()).select("path", "old_path", same.alias("status"))
    added = both.where(F.col("old_path").isNull()).select("path", "sha256")
    gone = both.where(F.col("path").isNull()).select("old_path", F.col("old_sha").alias("sha256"))
    alone = lambda rows: rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("sha256")
    pair = alone(added).join(alone(gone), "sha256")
    renamed = added.join(pair, "sha256").join(gone, "sha256").select("path", "old_path", F.lit("renamed").alias("status"))
    fresh = added.join(renamed.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status"))
    lost = gone.join(renamed.select("old_path"), "old_path", "left_anti").select(F.lit(None).cast("string").alias("path"), "old_path", F.lit("removed").alias("status"))
    return kept.unionByName(renamed).unionByName(fresh).unionByName(lost)


def with_ids(plan: DataFrame, old: DataFrame, salt: str) -> DataFrame:
    """path, doc_id, status: kept and renamed documents keep their id, others get an opaque new one."""
    o = old.select(F.col("path").alias("old_path"), F.col("doc_id").alias("_id"))
    fresh = F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "path"), 256), 1, 24))
    return plan.where("path is not null").join(o, "old_path", "left").select("path", F.coalesce("_id", fresh).alias("doc_id"), "status")


def diff_rows(old: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """One row: added, removed, changed, unchanged of two keyed tables."""
    a = old.select(*key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, key, "full_outer")
    ours, theirs = F.col("_in_new").isNotNull(), F.col("_in_old").isNotNull()
    return both.agg(
        F.count_if(ours & ~theirs).alias("added"),
        F.count_if(theirs & ~ours).alias("removed"),
        F.count_if(ours & theirs & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"),
        F.count_if(ours & theirs & F.col("_old").eqNullSafe(F.col("_new"))).alias("unchanged"),
    )


def reuse_vectors(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """chunks with the vector of previous whose id and hashes agree, else null (to be embedded).

    previous holds vectors of the current provider only.
    """
    return chunks.join(previous.select("chunk_id", "source_sha", "embedding_sha", "vector"), ["chunk_id", "source_sha", "embedding_sha"], "left")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id", "source_sha", "embedding_sha"), ["chunk_id", "source_sha", "embedding_sha"], "left_anti")


def audit_vectors(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """One row of counts: missing, stale, wrong_size, not_finite, zero, sound."""
    v = vectors.select("chunk_id", F.col("source_sha").alias("_sha"), "vector")
    j = chunks.join(v, "chunk_id", "left")
    missing = F.col("vector").isNull()
    stale = ~missing & (F.col("_sha") != F.col("source_sha"))
    wrong = ~missing & (F.size("vector") != dimensions)
    odd = ~missing & F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~missing & ~odd & F.forall("vector", lambda x: x == 0)
    sound = ~missing & ~stale & ~wrong & ~odd & ~zero
    named = {"missing": missing, "stale": stale, "wrong_size": wrong, "not_finite": odd, "zero": zero, "sound": sound}
    return j.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in named.items()])


def freshness(configured: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, status of configured(path, sha256) against indexed(path, sha256)."""
    i = indexed.select("path", F.col("sha256").alias("_sha"))
    status = F.when(F.col("_sha").isNull(), "NOT_INDEXED").when(F.col("sha256").isNull(), "MISSING_SOURCE").when(F.col("sha256") != F.col("_sha"), "STALE").otherwise("FRESH")
    return configured.join(i, "path", "full_outer").select("path", status.alias("status"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One hash over all (path, authority, priority, sha256), whatever their order."""
    line = F.concat_ws("|", "path", F.col("authority").cast("string"), F.col("priority").cast("string"), "sha256")
    # an order-free sum of row hashes: nothing is gathered
    part = lambda at: F.conv(F.substring(F.sha2(line, 256), at, 8), 16, 10).cast("long")
    return rows.agg(*[F.sum(part(at)).alias(f"sum{n}") for n, at in enumerate((1, 9, 17, 25))], F.count(F.lit(1)).alias("documents"))
