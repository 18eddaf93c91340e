"""Rank fusion of search channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal ranks, and the width of a score bucket.
RRF_CONSTANT = 60
BUCKET = 0.02


def reciprocal_ranks(ranked: DataFrame, key: list[str]) -> DataFrame:
    """ranked(query_id, channel, rank, key...): fused score and channels of each span."""
    part = 1.0 / (RRF_CONSTANT + F.col("rank"))
    return ranked.groupBy("query_id", *key).agg(F.sum(part).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def fused_order(fused: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each query: by score bucket (half-even), authority, priority, score, key."""
    bucket = F.bround(F.col("score") / BUCKET, 0)
    order = Window.partitionBy("query_id").orderBy(bucket.desc(), F.col("authority").desc(), F.col("priority").desc(), F.round("score", 9).desc(), *key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def span_cap(hits: DataFrame, per: list[str], cap: int, order: list) -> DataFrame:
    """At most cap hits of each group, best first."""
    w = Window.partitionBy(*per).orderBy(*order)
    return hits.withColumn("in_group", F.row_number().over(w).cast("long")).where(F.col("in_group") <= cap)
