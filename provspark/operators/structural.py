"""Structural search, line ranges and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_heading
from .markdown import lines_of


def search(sections: DataFrame, terms: DataFrame, k: int, pool: int | None = None) -> DataFrame:
    """sections(path, ordinal, heading_key, source_text, ...), terms(query_id, term).

    A section matches by its canonical heading (exact 0, prefix 1), else by the
    term in its text or by its whole path (2).  Of each term the ``pool`` best are
    looked at; a section counts once, with its best rank over the terms.  The k
    best of each query by rank, authority and priority (where there are such
    columns), path and place.
    """
    t = F.broadcast(terms.withColumn("term_key", canonical_heading(F.col("term"))))
    exact = F.col("heading_key") == F.col("term_key")
    prefix = F.startswith("heading_key", "term_key")
    other = F.contains("source_text", "term") | (F.col("path") == F.col("term"))
    rank = F.when(exact, 0).when(prefix, 1).otherwise(2)
    hits = sections.join(t, exact | prefix | other).withColumn("match_rank", rank).withColumn("score", 100 - rank)
    if pool:
        per_term = Window.partitionBy("query_id", "term").orderBy("match_rank", "path", "ordinal")
        hits = hits.withColumn("_place", F.row_number().over(per_term)).where(F.col("_place") <= pool).drop("_place")
        per_section = Window.partitionBy("query_id", "path", "ordinal").orderBy("match_rank", "term")
        hits = hits.withColumn("_place", F.row_number().over(per_section)).where(F.col("_place") == 1).drop("_place")
    weight = [F.col(c).desc() for c in ("authority", "priority") if pool and c in sections.columns]
    order = Window.partitionBy("query_id").orderBy("match_rank", *weight, "path", "ordinal")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def lines(sections: DataFrame, documents: DataFrame, first: int, last: int, key: str = "doc_id") -> DataFrame:
    """The parts of sections inside lines first..last (from 1, inclusive), hashed anew."""
    inside = sections.where((F.col("start_line") < last) & (F.col("end_line") > first - 1))
    begin, end = F.greatest("start_line", F.lit(first - 1)), F.least("end_line", F.lit(last))
    joined = inside.select("*", begin.alias("_a"), end.alias("_b")).join(documents.select(key, lines_of(F.col("text")).alias("_lines")), key)
    cut = F.slice("_lines", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))
    last = F.regexp_replace(F.element_at(cut, -1), r"(\r\n|\r|\n)\z", "")
    piece = F.concat(F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), ""), last)
    out = joined.withColumn("piece", piece).withColumn("sha256", F.sha2("piece", 256))
    return out.withColumn("start_line", (F.col("_a") + 1).cast("long")).withColumn("end_line", F.col("_b").cast("long")).drop("_a", "_b", "_lines")


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """cases(query_id, first: rank of the first right hit or null): recall at 1 and 3, mean reciprocal rank."""
    at = lambda n: F.round(F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0)), 6)
    return cases.agg(at(1).alias("recall_at_1"), at(3).alias("recall_at_3"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
