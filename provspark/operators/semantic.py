"""Brute-force vector search for a table of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blas import one_blas_thread

#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Query vectors that are broadcast at once.
QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def search(queries: DataFrame, vectors: DataFrame, k: int, tiebreak: list | None = None, make=None) -> DataFrame:
    """queries(query_id, q), vectors(vec_id, embedding, ...): the k nearest of each query.

    Up to QUERIES query vectors are one matrix that every task holds: a batch of
    vectors is scored by one product and sends on what can be among the k best of
    each query in its task so far, with ties, for the exact ranking.  Larger query tables are searched in parts of
    that size.

    make: a maker of providers; then ``embedding`` holds texts, which become vectors where they are scored.  A
    Python column function would queue every row that waits for its vector, text and all; that queue can go to disk.
    """
    from .lexical import top_k

    spark = vectors.sparkSession
    taken = queries.select("query_id", "q")
    parts = max(1, -(-taken.count() // QUERIES))
    fields = [f for f in vectors.schema if f.name not in ("embedding", "query_id", "score")]
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *columns, "score double"])
    found = None
    for n in range(parts):
        part = taken.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n) if parts > 1 else taken
        own = part.toArrow().combine_chunks()
        matrix = _unit(own.column("q").combine_chunks()) if own.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((own.column("query_id").combine_chunks(), matrix))
        scored = vectors.select(*(f.name for f in fields), "embedding").mapInArrow(_best_of_batch(shared, k, make), schema)
        found = scored if found is None else found.unionByName(scored)
    return top_k(found, k, tiebreak or ["vec_id"])


def _best_of_batch(shared, k: int, make=None):
    def run(batches):
        one_blas_thread()
        provider = make() if make else None
        ids, matrix = shared.value
        so_far = np.full(len(ids), -np.inf)
        for batch in (x for b in batches for x in (_slices(b) if provider else [b])):
            if not batch.num_rows or not len(matrix):
                continue
            own = batch.column("embedding")
            score = matrix @ (_scaled(provider.embed_documents([t or "" for t in own.to_pylist()])) if provider else _unit(own)).T
            rounded = np.round(score, 6)
            least = np.partition(rounded, -k, axis=1)[:, -k] if rounded.shape[1] > k else np.full(len(rounded), -np.inf)
            so_far = np.maximum(so_far, least)
            row, at = np.nonzero(rounded >= so_far[:, None])
            kept = batch.drop_columns(["embedding"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *kept.columns, pa.array(score[row, at])], names=["query_id", *kept.schema.names, "score"])

    return run


def _slices(batch: pa.RecordBatch):
    """Few enough texts to embed at once."""
    return (batch.slice(at, VECTOR_BLOCK) for at in range(0, batch.num_rows, VECTOR_BLOCK))


def _unit(column: pa.Array) -> np.ndarray:
    """A list column as rows of length one; zero rows stay zero."""
    if not len(column):
        return np.zeros((0, 0))
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _scaled(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _nearest(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries, vectors = (batch.column(c).slice(i, 1).flatten() for c in ("queries", "vectors"))
                score = np.round(_unit(queries.field("q")) @ _unit(vectors.field("embedding")).T, 6)
                ids = vectors.field("vec_id").to_numpy()
                by_id = np.argsort(ids)
                best = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
                row = np.repeat(np.arange(len(best)), best.shape[1])
                columns = [queries.field("query_id").take(pa.array(row)), pa.array(ids[best.ravel()]), pa.array(score[row, best.ravel()])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def search_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank as of :func:`search`, for query tables that grow with the vectors.

    Blocks of queries meet blocks of vectors in one product each; nothing is
    broadcast on purpose, and the k best of every pair of blocks are ranked.
    """

    def blocks(df: DataFrame, size: int, key: str, name: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(*df.columns)).alias(name)).drop("block")

    pairs = blocks(queries.select("query_id", "q"), QUERY_BLOCK, "query_id", "queries").crossJoin(blocks(vectors.select("vec_id", "embedding"), VECTOR_BLOCK, "vec_id", "vectors"))
    types = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString())
    # few rows a batch: a row holds two blocks
    best = pairs.mapInArrow(_nearest(k), f"query_id {types[0]}, vec_id {types[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
