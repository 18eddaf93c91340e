"""Connected components over an edge table: small ones in one task, larger ones by DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialize

#: Edges up to which one task joins the components (16 bytes each); the rounds of joins would only wait for their stages.
IN_ONE_TASK = 500_000


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (a, b), sorted, and the least vertex of each one's component."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(vertices))
    while True:
        apart = label[x] != label[y]
        if not apart.any():
            return vertices, vertices[label]
        x, y = label[x[apart]], label[y[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(batches):
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    v, label = least_connected(table.column("a").to_numpy(), table.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(label, pa.int64())], names=["v", "label"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) of each vertex of edges(a, b): label is its component's least vertex.

    Beyond ``IN_ONE_TASK`` edges, labels spread over edges and then jump to their
    labels' labels, so stars take two rounds and long chains a logarithmic number.
    Each round is a written table; vertices and edges are never collected.
    """
    if edges.count() <= IN_ONE_TASK:
        return materialize(edges.select("a", "b").repartition(1).mapInArrow(_in_one_task, "v long, label long"), "labels")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        above = labels.select(F.col("v").alias("mid"), F.col("label").alias("top"))
        jumped = materialize(spread.join(above, "mid").select("v", "old", F.least("mid", "top").alias("label")), "labels")
        drop_table(labels)
        labels = jumped.select("v", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            drop_table(both)
            return labels
