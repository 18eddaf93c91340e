"""Intermediate tables.

They go to the folder that ``spark.checkpoint.dir`` names, which every executor
of a cluster can read: a lost executor never takes results with it.  Tables
that no result reads any more are deleted as soon as possible.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        sc = spark.sparkContext
        configured = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not configured:  # one machine: driver and executors are one process
        configured = tempfile.mkdtemp(prefix="provspark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Folders of tables that results may still read, by application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back; options are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def mark(spark: SparkSession) -> int:
    """A point in the list of written tables; see :func:`release`."""
    return len(_written.setdefault(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: tuple = ()) -> None:
    """Delete the tables written after ``since`` but those that ``keep`` reads.

    For a caller that has read or written out every result that depends on them.
    """
    paths = _written.setdefault(spark.sparkContext.applicationId, [])
    read = {f.rsplit("/", 1)[0].split("/provspark/")[-1] for df in keep for f in df.inputFiles()}
    kept = [p for p in paths[since:] if p.split("/provspark/")[-1] in read]
    for path in paths[since:]:
        if path not in kept:
            _delete(spark, path)
    paths[since:] = kept


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialize`."""
    spark = df.sparkSession
    paths = _written.setdefault(spark.sparkContext.applicationId, [])
    read = {f.rsplit("/", 1)[0].split("/provspark/")[-1] for f in df.inputFiles()}
    for path in [p for p in paths if p.split("/provspark/")[-1] in read]:
        _delete(spark, path)
        paths.remove(path)
